"""Retrieval quality over (query_id, rank, key) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, expected: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, hits, recall): expected (query_id, key) rows that are among a query's first k found."""
    found = found.filter(F.col("rank") <= k) if k else found
    hit = expected.join(found.select("query_id", "key", F.lit(1).alias("hit")).distinct(), ["query_id", "key"], "left")
    return hit.groupBy("query_id").agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def ndcg(found: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, dcg, ndcg): gains of the first k against the best order of the expected (query_id, key, relevance)."""
    from pyspark.sql import Window

    gain = lambda rank: F.col("relevance") / F.log2(rank + 1)
    got = found.filter(F.col("rank") <= k).join(relevance, ["query_id", "key"]).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    best = relevance.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "key"))).filter(F.col("place") <= k)
    best = best.groupBy("query_id").agg(F.sum(gain(F.col("place"))).alias("best"))
    out = best.join(got, "query_id", "left").select("query_id", F.coalesce("dcg", F.lit(0.0)).alias("dcg"), "best")
    return out.select("query_id", "dcg", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def mean_recall(found: DataFrame, expected: DataFrame, k: int | None = None) -> DataFrame:
    """(queries, hits, recall): over all queries of expected."""
    return recall(found, expected, k).agg(F.count("*").alias("queries"), F.sum("hits").alias("hits"), F.avg("recall").alias("recall"))


def self_recall(found: DataFrame, k: int | None = None) -> DataFrame:
    """(queries, hits, recall) of queries that are rows of the table searched: how many find their own key."""
    return mean_recall(found, found.select("query_id", F.col("query_id").alias("key")).distinct(), k)
