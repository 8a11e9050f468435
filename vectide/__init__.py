"""A vector analytics engine on Spark: distances, exact and approximate search, clustering, joins and vector tables."""
