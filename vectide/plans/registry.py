"""Registered queries of the vector engine and their SQL equivalents for DuckDB.

Searches take every row whose id is divisible by 50 as queries, against all rows. Distances are rounded to 6 digits
on both sides; ranks are by the distance rounded to 9 digits, then key."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import metrics, quality, quantize, strings
from vectide.functions.sql import register
from vectide.operators import ann, cluster, join, knn
from vectide.operators.table import Config, VectorTable
from vectide.sources.folder import forget, shared_folder, written
from vectide.sources.matrix import load_matrix, random_vectors, save_matrix
from vectide.streaming.upsert import within

K = 10
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """(key, vector, label); scaled: lengths of 1 + label, so that metrics differ."""
    v = F.transform("embedding", lambda x: x * (1 + F.col("label")).cast("float")) if scaled else F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), v.alias("vector"), "label")


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.filter("key % 50 = 0").select(F.col("key").alias("query_id"), "vector")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("distance",)})


E = "e AS (SELECT vec_id AS key, label, embedding::DOUBLE[] AS v FROM embeddings)"
S = "e AS (SELECT vec_id AS key, label, list_transform(embedding, lambda x: (x * (1 + label)::FLOAT)::FLOAT)::DOUBLE[] AS v FROM embeddings)"
IP = "1 - list_inner_product({a}, {b})"
COS = "1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def at(f: str, a: str = "q.v", b: str = "x.v") -> str:
    return f.format(a=a, b=b)


def knn_sql(f: str, source: str = E, where: str = "true", k: int = K, out: str = "", by: str = "") -> str:
    """Ranked neighbours; where: over q, x and d."""
    return f"""WITH {source}, p AS (SELECT q.key AS query_id, x.key AS key, x.label AS label, {at(f)} AS d FROM e q, e x WHERE q.key % 50 = 0),
r AS (SELECT query_id, key, label, d, row_number() OVER (PARTITION BY query_id{by} ORDER BY d, key) AS n FROM p WHERE {where})
SELECT query_id, n::INTEGER AS rank, key, round(d, 6) + 0.0 AS distance{out} FROM r WHERE n <= {k}"""


@query(knn_sql(COS))
def knn_cos(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, K, "cos"))


@query(knn_sql(IP, S))
def knn_ip(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=True)
    return rounded(knn.search(queries_of(x), x, K, "ip"))


@query(knn_sql(L2, S))
def knn_l2sq(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=True)
    return rounded(knn.search(queries_of(x), x, K, "l2sq"))


@query(knn_sql(L2, S))
def knn_native_l2sq(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=True)
    return rounded(knn.search(queries_of(x), x, K, "l2sq", native=True))


@query(knn_sql(COS, where="label = 3"))
def knn_filtered(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, K, "cos", where=F.col("label") == 3))


@query(knn_sql(COS, where="d <= 0.8"))
def knn_radius(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, K, "cos", radius=0.8))


@query(knn_sql(COS, where="key <> query_id", k=1))
def knn_min1(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, 1, "cos", exclude_self=True))


@query(knn_sql(COS, where="key <> query_id"))
def knn_excl_self(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, K, "cos", exclude_self=True))


@query(knn_sql(COS, k=3, out=", label", by=", label"))
def knn_per_label(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.search(queries_of(x), x, 3, "cos", per="label"))


@query(knn_sql(COS))
def knn_sharded(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(knn.sharded(queries_of(x), [x.filter(F.col("key") % 4 == i).select("key", "vector") for i in range(4)], K, "cos"))


def neighbours(spark, sf_dir, scaled=False, prepare=lambda v: v):
    """Each vector with the one of the next id, an equi-join: (left_key, right_key, a, b)."""
    x = vectors(spark, sf_dir, scaled).select("key", prepare(F.col("vector")).alias("vector"))
    return x.select(F.col("key").alias("left_key"), F.col("vector").alias("a")).join(x.select(F.col("key").alias("right_key"), (F.col("key") - 1).alias("left_key"), F.col("vector").alias("b")), "left_key")


def dist(name, spark, sf_dir, scaled=False, prepare=lambda v: v):
    return rounded(neighbours(spark, sf_dir, scaled, prepare).select("left_key", "right_key", metrics.metric(name)(F.col("a"), F.col("b")).cast("double").alias("distance")))


def dist_sql(f: str, source: str = S) -> str:
    return f"WITH {source} SELECT q.key AS left_key, x.key AS right_key, round(({at(f)})::DOUBLE, 6) + 0.0 AS distance FROM e q JOIN e x ON x.key = q.key + 1"


@query(dist_sql(IP))
def dist_ip(spark, sf_dir):
    return dist("ip", spark, sf_dir, True)


@query(dist_sql(COS))
def dist_cos(spark, sf_dir):
    return dist("cosine", spark, sf_dir, True)


@query(dist_sql(L2))
def dist_l2sq(spark, sf_dir):
    return dist("l2_sq", spark, sf_dir, True)


_P = "(64 * list_inner_product({a}, {b}) - list_sum({a}) * list_sum({b})) / sqrt((64 * list_inner_product({a}, {a}) - list_sum({a}) ** 2) * (64 * list_inner_product({b}, {b}) - list_sum({b}) ** 2))"


@query(dist_sql("1 - " + _P))
def dist_pearson(spark, sf_dir):
    return dist("pearson", spark, sf_dir, True)


_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * ln((z[1] + pow(2, -23)) / ((z[1] + z[2]) / 2 + pow(2, -23))) + z[2] * ln((z[2] + pow(2, -23)) / ((z[1] + z[2]) / 2 + pow(2, -23))))) / 2"


@query(dist_sql(_D, "d AS (SELECT vec_id AS key, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v FROM embeddings), e AS (SELECT key, list_transform(v, lambda x: x / list_sum(v)) AS v FROM d)"))
def dist_divergence(spark, sf_dir):
    def shares(v):
        v = F.transform(v.cast("array<double>"), F.abs)
        return F.element_at(F.transform(F.array(F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda s, y: s + y).alias("sum"))), lambda r: F.transform(r["v"], lambda x: x / r["sum"])), 1)

    return dist("divergence", spark, sf_dir, prepare=shares)


@query("""WITH c AS (SELECT c_custkey AS k, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer)
SELECT a.k AS left_key, b.k AS right_key, round(2 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) + 0.0 AS distance
FROM c a JOIN c b ON b.k = a.k + 1""")
def dist_haversine(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("key"), F.array((k * 37 % 180 - 90).cast("double"), (k * 91 % 360 - 180).cast("double")).alias("v"))
    pairs = c.select(F.col("key").alias("left_key"), F.col("v").alias("a")).join(c.select(F.col("key").alias("right_key"), (F.col("key") - 1).alias("left_key"), F.col("v").alias("b")), "left_key")
    return rounded(pairs.select("left_key", "right_key", metrics.haversine(F.col("a"), F.col("b")).alias("distance")))


def bits_sql(f: str) -> str:
    """f over both, either, na, nb: numbers of set bits."""
    z = "list_sum(list_transform(list_zip(q.v, x.v), lambda z: ({})::INTEGER))"
    c = f"SELECT q.key AS left_key, x.key AS right_key, {z.format('z[1] > 0 AND z[2] > 0')} AS both_, {z.format('z[1] > 0 OR z[2] > 0')} AS either_, {z.format('z[1] > 0')} AS na, {z.format('z[2] > 0')} AS nb FROM e q JOIN e x ON x.key = q.key + 1"
    return f"WITH {E}, c AS ({c}) SELECT left_key, right_key, round(({f})::DOUBLE, 6) + 0.0 AS distance FROM c"


@query(bits_sql("either_ - both_"))
def bits_hamming(spark, sf_dir):
    return dist("hamming", spark, sf_dir, prepare=quantize.to_bits)


@query(bits_sql("1 - both_ / either_"))
def bits_tanimoto(spark, sf_dir):
    return dist("tanimoto", spark, sf_dir, prepare=quantize.to_bits)


@query(bits_sql("1 - 2 * both_ / (na + nb)"))
def bits_sorensen(spark, sf_dir):
    return dist("sorensen", spark, sf_dir, prepare=quantize.to_bits)


I8 = "i AS (SELECT vec_id AS key, label, list_transform(embedding::DOUBLE[], lambda x: trunc(x * 127 / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS v FROM embeddings)"


@query(f"WITH {I8} SELECT key, generate_subscripts(v, 1)::INTEGER - 1 AS dim, unnest(v)::INTEGER AS value FROM i")
def quant_i8(spark, sf_dir):
    return vectors(spark, sf_dir).select("key", F.posexplode(quantize.to_i8(F.col("vector"))).alias("dim", "value")).select("key", "dim", F.col("value").cast("int").alias("value"))


@query(knn_sql(L2, I8 + ", e AS (SELECT * FROM i)"))
def knn_i8(spark, sf_dir):
    x = vectors(spark, sf_dir).withColumn("vector", quantize.to_i8(F.col("vector")))
    return rounded(knn.search(queries_of(x), x, K, "l2sq"))


_T = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]+'))"


@query(f"""WITH t AS (SELECT doc_id AS k, {_T.format("text")} AS s FROM documents)
SELECT a.k AS left_key, b.k AS right_key, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) + 0.0 AS distance
FROM t a JOIN t b ON b.k = a.k + 1 WHERE len(a.s) + len(b.s) > 0""")
def jaccard_sets(spark, sf_dir):
    s = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), s.alias("s"))
    pairs = t.select(F.col("key").alias("left_key"), F.col("s").alias("a")).join(t.select(F.col("key").alias("right_key"), (F.col("key") - 1).alias("left_key"), F.col("s").alias("b")), "left_key")
    return rounded(pairs.filter(F.size("a") + F.size("b") > 0).select("left_key", "right_key", metrics.jaccard(F.col("a"), F.col("b")).alias("distance")))


_WORDS = "w AS (SELECT doc_id, string_split_regex(text, '[ \n]') AS x FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, CASE WHEN len(x) < 2 THEN list_append(x, '') ELSE x END AS w FROM w), p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS z FROM t)"
#: The letters beyond ASCII that the text has.
_LETTERS = "ÄÖÜäöüßçÇèÈéÉêÊñÑíÍóÓàâôûú"
_ONE_BYTE = "translate({}, '" + _LETTERS + "', " + " || ".join(f"chr({i if i < 9 else i + 5})" for i in range(1, len(_LETTERS) + 1)) + ")"


def _word_pairs(spark, sf_dir):
    """(row, doc_id, a, b): all neighbouring words of each document; the empty word stands beside an only one."""
    w = F.split("text", "[ \\n]", -1)
    w = F.when(F.size(w) < 2, F.concat(w, F.array(F.lit("")))).otherwise(w)
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "doc_id", w.alias("w"))
    n = F.size("w") - 1
    pairs = d.select("row", "doc_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("p"))
    return pairs.select("row", "doc_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def _whole(pairs: DataFrame, **sums) -> DataFrame:
    """A row for each document: the sums over its pairs."""
    return pairs.groupBy("row", "doc_id").agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()]).drop("row")


def _whole_sql(**sums: str) -> str:
    """z.a and z.b: the two words."""
    parts = ", ".join(f"sum({f})::BIGINT AS {name}" for name, f in sums.items())
    return f"WITH {_WORDS}, d AS (SELECT doc_id, z[1] AS a, z[2] AS b FROM p) SELECT doc_id, {parts} FROM d GROUP BY doc_id"


def _ham(a: str, b: str) -> str:
    return f"(coalesce(list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: (substr({a}, i, 1) <> substr({b}, i, 1))::INTEGER)), 0) + abs(length({a}) - length({b})))::INTEGER"


def _ham_bytes(a: str, b: str) -> str:
    x, y = f"hex(encode({a}))", f"hex(encode({b}))"
    return f"(coalesce(list_sum(list_transform(range(0, least(length({x}), length({y})) // 2), lambda i: (substr({x}, 2 * i + 1, 2) <> substr({y}, 2 * i + 1, 2))::INTEGER)), 0) + abs(length({x}) - length({y})) // 2)::INTEGER"


@query(_whole_sql(distance="levenshtein(a, b)", bounded="least(levenshtein(a, b), 3)"))
def levenshtein_bytes(spark, sf_dir):
    """Whole texts: the distances of all neighbouring words, summed for each document."""
    d = _word_pairs(spark, sf_dir).select("row", "doc_id", strings.levenshtein_bytes(F.col("a"), F.col("b")).alias("d"))
    return _whole(d, distance=F.col("d"), bounded=F.least("d", F.lit(3)))


@query(_whole_sql(distance="levenshtein(one(a), one(b))", bounded="least(levenshtein(one(a), one(b)), 4)").replace("one(a)", _ONE_BYTE.format("a")).replace("one(b)", _ONE_BYTE.format("b")))
def levenshtein_unicode(spark, sf_dir):
    d = _word_pairs(spark, sf_dir).select("row", "doc_id", strings.levenshtein_unicode(F.col("a"), F.col("b")).alias("d"))
    return _whole(d, distance=F.col("d"), bounded=F.least("d", F.lit(4)))


@query(_whole_sql(distance=_ham("a", "b"), bounded=f"least({_ham('a', 'b')}, 3)"))
def hamming_unicode(spark, sf_dir):
    d = _word_pairs(spark, sf_dir).select("row", "doc_id", strings.hamming_unicode(F.col("a"), F.col("b")).alias("d"))
    return _whole(d, distance=F.col("d"), bounded=F.least("d", F.lit(3)))


@query(_whole_sql(distance=_ham_bytes("a", "b")))
def hamming_bytes(spark, sf_dir):
    d = _word_pairs(spark, sf_dir).select("row", "doc_id", strings.hamming_bytes(F.col("a"), F.col("b")).alias("d"))
    return _whole(d, distance=F.col("d"))


def by_label(spark, sf_dir) -> VectorTable:
    return VectorTable(Config(64, multi=True), vectors(spark, sf_dir).select(F.col("label").cast("long").alias("key"), "vector"))


def by_id(spark, sf_dir) -> VectorTable:
    return VectorTable(Config(64), vectors(spark, sf_dir).select("key", "vector"))


@query("SELECT 2 * l_partkey AS key, 2 * l_partkey IN (SELECT vec_id FROM embeddings) AS found FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def crud_contains(spark, sf_dir):
    return by_id(spark, sf_dir).contains(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("key")).distinct())


@query("SELECT p_partkey AS key, (SELECT count(*) FROM embeddings WHERE label = p_partkey) AS n FROM part")
def crud_count_multi(spark, sf_dir):
    return by_label(spark, sf_dir).count(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))


@query("SELECT vec_id AS key FROM embeddings WHERE vec_id NOT IN (SELECT 2 * c_custkey FROM customer)")
def crud_remove(spark, sf_dir):
    return by_id(spark, sf_dir).remove(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("key"))).rows.select("key")


@query("SELECT CASE WHEN label = 1 THEN 2 ELSE label END::BIGINT AS key, count(*) AS n FROM embeddings GROUP BY 1")
def crud_rename(spark, sf_dir):
    names = spark.createDataFrame([(1, 2)], "old long, new long")
    return by_label(spark, sf_dir).rename(names).rows.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS key, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def crud_get(spark, sf_dir):
    got = by_id(spark, sf_dir).get(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))
    return got.select("key", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT vec_id AS key, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings")
def crud_add(spark, sf_dir):
    x = vectors(spark, sf_dir)
    added = by_id(spark, sf_dir).add(x.select((F.col("key") + 1000000).alias("key"), "vector"))
    return added.rows.select("key").join(x.select(F.col("key").alias("k"), "label"), F.col("key") % 1000000 == F.col("k")).select("key", "label")


@query(f"WITH {S} SELECT q.key AS left_key, x.key AS right_key, 1::BIGINT AS n, round({at(L2)}, 6) + 0.0 AS mean FROM e q JOIN e x ON x.key = q.key + 1")
def pairwise_by_key(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=True)
    pairs = x.select(F.col("key").alias("left_key"), (F.col("key") + 1).alias("right_key")).join(x.select(F.col("key").alias("right_key")), "right_key")
    return rounded(knn.pairwise(x, x, pairs, "l2sq").select("left_key", "right_key", "n", "mean"), "mean")


@query(f"""WITH {E}, l AS (SELECT key // 50 AS g, v FROM e WHERE key % 2 = 0), r AS (SELECT key // 50 AS g, v FROM e WHERE key % 2 = 1)
SELECT q.g AS left_key, x.g AS right_key, count(*) AS n, round(avg({at(L2)}), 6) + 0.0 AS mean, round(min({at(L2)}), 6) + 0.0 AS min, round(max({at(L2)}), 6) + 0.0 AS max FROM l q JOIN r x ON q.g = x.g GROUP BY 1, 2""")
def pairwise_multi_agg(spark, sf_dir):
    """Keys that stand for up to 25 vectors each: the group of 50 ids that a vector's id falls in."""
    x = vectors(spark, sf_dir).withColumn("id", F.col("key")).withColumn("key", F.floor(F.col("key") / 50))
    pairs = x.select(F.col("key").alias("left_key"), F.col("key").alias("right_key")).distinct()
    return rounded(knn.pairwise(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"), pairs, "l2sq").filter("n > 0"), "mean", "min", "max")


def _top(f: str, name: str, source: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT q.key AS query_id, x.key AS key, row_number() OVER (PARTITION BY q.key ORDER BY {at(f)}, x.key) AS n FROM {source} q, {source} x WHERE q.key % 50 = 0) WHERE n <= {K})"


@query(f"WITH {E}, {I8}, {_top(COS, 'a', 'e')}, {_top(L2, 'b', 'i')} SELECT a.query_id, count(b.key) AS hits, round(count(b.key) / count(*), 6) + 0.0 AS recall FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.key = b.key GROUP BY 1")
def recall_at_k(spark, sf_dir):
    """Of 8-bit search against exact search."""
    x = vectors(spark, sf_dir)
    small = x.withColumn("vector", quantize.to_i8(F.col("vector")))
    return rounded(quality.recall(knn.search(queries_of(small), small, K, "l2sq"), knn.search(queries_of(x), x, K, "cos").select("query_id", "key")), "recall")


@query(f"""WITH {E}, {I8}, {_top(COS, 'a', 'e')}, {_top(L2, 'b', 'i')}, g AS (SELECT b.query_id, sum(({K} + 1 - a.n) / log2(b.n + 1)) AS dcg FROM b JOIN a ON a.query_id = b.query_id AND a.key = b.key GROUP BY 1),
i2 AS (SELECT query_id, sum(({K} + 1 - n) / log2(n + 1)) AS best FROM a GROUP BY 1)
SELECT i2.query_id, round(coalesce(dcg, 0), 6) + 0.0 AS dcg, round(coalesce(dcg, 0) / best, 6) + 0.0 AS ndcg FROM i2 LEFT JOIN g USING (query_id)""")
def ndcg_at_k(spark, sf_dir):
    x = vectors(spark, sf_dir)
    small = x.withColumn("vector", quantize.to_i8(F.col("vector")))
    exact = knn.search(queries_of(x), x, K, "cos").select("query_id", "key", (F.lit(K + 1) - F.col("rank")).cast("double").alias("relevance"))
    return rounded(quality.ndcg(knn.search(queries_of(small), small, K, "l2sq"), exact, K), "dcg", "ndcg")


def _fixed_starts(x: DataFrame):
    return np.array([r.vector for r in x.filter("key < 10").orderBy("key").collect()], dtype=float)


_ASSIGN = f"a AS (SELECT x.key, arg_min(c.key, {at(L2, 'x.v', 'c.v')}) AS cluster, min({at(L2, 'x.v', 'c.v')}) AS d FROM e x, e c WHERE c.key < 10 GROUP BY 1)"


@query(f"WITH {E}, {_ASSIGN} SELECT key, cluster::INTEGER AS cluster, round(d, 6) + 0.0 AS distance FROM a")
def kmeans_assign_step(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(cluster.assign(x, _fixed_starts(x), "l2sq"))


@query(f"WITH {E}, {_ASSIGN}, u AS (SELECT cluster, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM a JOIN e USING (key)) SELECT cluster::INTEGER AS cluster, dim::INTEGER AS dim, round(avg(x), 6) + 0.0 AS value FROM u GROUP BY 1, 2")
def kmeans_update_step(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return rounded(cluster.update(cluster.assign(x, _fixed_starts(x), "l2sq", "vector"), "l2sq"), "value")


def _kmeans_sql(rounds: int) -> str:
    """Rounds of assignment and means from the vectors of keys 0 to 7."""
    ctes = [E, "c0 AS (SELECT key::INTEGER AS c, v FROM e WHERE key < 8)"]
    for i in range(rounds):
        ctes.append(f"a{i} AS (SELECT x.key, x.v, arg_min(c.c, ({at(L2, 'x.v', 'c.v')}, c.c)) AS c FROM e x, c{i} c GROUP BY x.key, x.v)")
        ctes.append(f"u{i} AS (SELECT c, d, avg(x) AS x FROM (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM a{i}) GROUP BY c, d)")
        ctes.append(f"c{i + 1} AS (SELECT c, list(x ORDER BY d) AS v FROM u{i} GROUP BY c)")
    last = at(L2, "x.v", "c.v")
    return f"WITH {', '.join(ctes)} SELECT x.key, arg_min(c.c, ({last}, c.c)) AS cluster, round(min({last}), 6) + 0.0 AS distance FROM e x, c{rounds} c GROUP BY x.key"


@query(_kmeans_sql(4))
def kmeans_full(spark, sf_dir):
    """Four rounds from fixed starts."""
    x = vectors(spark, sf_dir).select("key", "vector")
    return rounded(cluster.kmeans(x, 8, max_iterations=4, inertia_threshold=-1, min_shifts=-1, first=_fixed_starts(x)[:8])[0])


LISTS, PROBES = 16, 12


@query()
def ann_ivf(spark, sf_dir):
    x = vectors(spark, sf_dir).select("key", "vector")
    index, centroids = ann.build(x, LISTS)
    return rounded(ann.search(queries_of(x), index, centroids, K, probes=PROBES))


@query("SELECT count(*) AS queries, true AS reached, true AS exact FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf_dir):
    """Whether the approximate search finds 0.9 of the exact neighbours, and all of them when it probes all lists."""
    x = vectors(spark, sf_dir).select("key", "vector")
    index, centroids = ann.build(x, LISTS)
    index = written(index, "index")
    exact = written(knn.search(queries_of(x), x, K), "exact")
    found = [quality.mean_recall(ann.search(queries_of(x), index, centroids, K, p), exact.select("query_id", "key")).first() for p in (PROBES, LISTS)]
    forget(index, exact)
    return spark.createDataFrame([(found[0].queries, found[0].recall >= 0.9, found[1].recall == 1.0)], "queries long, reached boolean, exact boolean")


@query("SELECT count(*) AS queries, count(*) AS hits, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % 50 = 0")
def self_recall(spark, sf_dir):
    """Every query is a row of the table and finds itself."""
    x = vectors(spark, sf_dir)
    return quality.self_recall(knn.search(queries_of(x), x, 1))


_LEVEL = "floor(-ln(((((vec_id % 4294967296) + 1) * 2654435761) % 4294967296 + 0.5) / 4294967296.0) / ln({}))"


@query(f"WITH l AS (SELECT {_LEVEL.format(4.0)}::INTEGER AS top FROM embeddings), n AS (SELECT unnest(range(0, top + 1))::INTEGER AS level FROM l), c AS (SELECT level, count(*) AS nodes FROM n GROUP BY 1) SELECT level, nodes, nodes * least(CASE level WHEN 0 THEN 8 ELSE 4 END, nodes - 1) AS edges, nodes * CASE level WHEN 0 THEN 8 ELSE 4 END AS max_edges FROM c")
def level_stats(spark, sf_dir):
    return cluster.level_stats(vectors(spark, sf_dir), 4)


_CL = f"{E}, m AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings WHERE {_LEVEL.format(4.0)} >= 2), c AS (SELECT x.key, arg_min(m.key, {at(COS, 'x.v', 'm.v')}) AS centroid, min({at(COS, 'x.v', 'm.v')}) AS d FROM e x, m GROUP BY 1)"


@query(f"WITH {_CL} SELECT key, centroid, round(d, 6) + 0.0 AS distance FROM c")
def cluster_level(spark, sf_dir):
    return rounded(cluster.cluster_by_level(vectors(spark, sf_dir), 2, "cos", 4))


@query(f"WITH {_CL} SELECT centroid, count(*) AS size FROM c GROUP BY 1")
def cluster_popularity(spark, sf_dir):
    return cluster.popularity(cluster.cluster_by_level(vectors(spark, sf_dir), 2, "cos", 4))


_MERGE = f"""WITH RECURSIVE {_CL}, z AS (SELECT centroid, count(*) AS n FROM c GROUP BY 1), f AS (SELECT z.centroid, z.n, m.v FROM z JOIN m ON m.key = z.centroid),
s(step, alive) AS (SELECT 0, (SELECT list({{'c': centroid, 'n': n, 'e': centroid}} ORDER BY centroid) FROM f) UNION ALL
  SELECT step + 1, list_transform(alive, lambda a: {{'c': a.c, 'n': CASE WHEN a.c = a.e AND a.c = t.t THEN a.n + t.n WHEN a.c = t.g THEN 0 ELSE a.n END, 'e': CASE WHEN a.e = t.g THEN t.t ELSE a.e END}}) FROM
  (SELECT step, alive, g, n, (SELECT arg_min(o.centroid, ({at(COS, 'w.v', 'o.v')}, o.centroid)) FROM f w, f o WHERE w.centroid = g AND o.centroid <> g AND list_contains(list_transform(alive, lambda a: a.e), o.centroid)) AS t FROM
    (SELECT step, alive, (list_sort(list_transform(list_filter(alive, lambda a: a.c = a.e), lambda a: {{'n': a.n, 'k': -a.c}})))[1].k * -1 AS g, (list_sort(list_transform(list_filter(alive, lambda a: a.c = a.e), lambda a: {{'n': a.n, 'k': -a.c}})))[1].n AS n
     FROM s WHERE len(list_filter(alive, lambda a: a.c = a.e)) > 10)) t),
l AS (SELECT unnest(alive) AS a FROM s ORDER BY step DESC LIMIT (SELECT count(*) FROM f)), k AS (SELECT a.c AS centroid, a.e AS last FROM l)
SELECT x.key, k.last AS centroid, round({at(COS, 'x.v', 'o.v')}, 6) + 0.0 AS distance FROM e x JOIN c ON c.key = x.key JOIN k ON k.centroid = c.centroid JOIN f o ON o.centroid = k.last"""


@query(_MERGE)
def cluster_counts(spark, sf_dir):
    """The nearest members of a level, the least popular merged until ten are left."""
    x = vectors(spark, sf_dir).select("key", "vector")
    stats = {r.level: r.nodes for r in cluster.level_stats(x, 4).collect()}
    return rounded(cluster.cluster(x, stats[2] - 1, 10))


@query(f"SELECT centroid, count(*) AS size, sum(key)::BIGINT AS keys FROM ({_MERGE}) GROUP BY 1")
def cluster_members(spark, sf_dir):
    """The members of every centroid."""
    x = vectors(spark, sf_dir).select("key", "vector")
    stats = {r.level: r.nodes for r in cluster.level_stats(x, 4).collect()}
    found = written(cluster.cluster(x, stats[2] - 1, 10), "clusters")
    parts = [cluster.members_of(found, r.centroid) for r in found.select("centroid").distinct().collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("centroid").agg(F.count("*").alias("size"), F.sum("key").alias("keys"))


@query(f"WITH {_CL}, n AS (SELECT DISTINCT centroid FROM c) SELECT q.key AS a, x.key AS b, round({at(COS)}, 6) + 0.0 AS distance FROM e q, e x WHERE q.key IN (FROM n) AND x.key IN (FROM n) AND q.key < x.key")
def cluster_network(spark, sf_dir):
    x = vectors(spark, sf_dir).select("key", "vector")
    return rounded(cluster.network(x, cluster.cluster_by_level(x, 2, "cos", 4))[1])


@query(f"""WITH RECURSIVE {E}, p AS (SELECT q.key AS l, x.key AS r, round({at(COS)}, 12) AS d FROM e q, e x WHERE q.key % 50 = 0 AND x.key % 50 <> 0),
g(step, ls, rs, b) AS (SELECT 0, []::BIGINT[], []::BIGINT[], NULL::STRUCT(l BIGINT, r BIGINT, d DOUBLE) UNION ALL
  SELECT step + 1, list_append(ls, b.l), list_append(rs, b.r), b FROM (SELECT step, ls, rs, (SELECT arg_min({{'l': l, 'r': r, 'd': d}}, (d, r, l)) FROM p WHERE NOT list_contains(ls, l) AND NOT list_contains(rs, r)) AS b FROM g) WHERE b IS NOT NULL)
SELECT b.l AS left_key, b.r AS right_key, round(b.d, 6) + 0.0 AS distance FROM g WHERE b IS NOT NULL""")
def stable_join(spark, sf_dir):
    """One-to-one match of every row whose id is divisible by 50 with the other rows."""
    x = vectors(spark, sf_dir).select("key", "vector")
    return rounded(join.stable_match(x.filter("key % 50 = 0"), x.filter("key % 50 <> 0")))


@query(dist_sql(COS, E))
def sql_distance_json(spark, sf_dir):
    register(spark)
    pairs = neighbours(spark, sf_dir).select("left_key", "right_key", F.to_json(F.col("a").cast("array<double>")).alias("a"), F.to_json(F.col("b").cast("array<double>")).alias("b"))
    return rounded(pairs.selectExpr("left_key", "right_key", "distance_cosine_f32(a, b) AS distance"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - l_tax) ** 2 + (l_discount - l_tax) ** 2, 6) + 0.0 AS distance FROM lineitem")
def sql_distance_columns(spark, sf_dir):
    register(spark)
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "round(distance_sqeuclidean_f64(l_quantity, l_discount, l_tax, l_tax), 6) AS distance")


@query(_whole_sql(lev="levenshtein(a, b)", ham2=f"least({_ham('a', 'b')}, 2)"))
def sql_distance_strings(spark, sf_dir):
    register(spark)
    d = _word_pairs(spark, sf_dir).selectExpr("row", "doc_id", "distance_levenshtein_bytes(a, b) AS lev", "distance_hamming_unicode(a, b, 2) AS ham2")
    return _whole(d, lev=F.col("lev"), ham2=F.col("ham2"))


_DENSE = {"sqeuclidean": L2, "cosine": COS, "inner": IP, "divergence": _D}
_KINDS = {"f64": "DOUBLE", "f32": "FLOAT", "f16": "FLOAT", "i8": "FLOAT"}


@query("WITH e AS (SELECT vec_id AS key, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v64, list_transform(embedding, lambda x: abs(x)::FLOAT)::DOUBLE[] AS v32 FROM embeddings) SELECT q.key AS left_key, "
       + ", ".join(f"round(({f.format(a=f'q.v{64 if k == 'f64' else 32}', b=f'x.v{64 if k == 'f64' else 32}')})::DOUBLE, 6) + 0.0 AS {m}_{k}" for m, f in _DENSE.items() for k in _KINDS) + " FROM e q JOIN e x ON x.key = q.key + 1")
def sql_distance_dense(spark, sf_dir):
    """All 16 dense functions on text."""
    register(spark)
    pairs = neighbours(spark, sf_dir, prepare=lambda v: F.to_json(F.transform(v.cast("array<double>"), F.abs)))
    return pairs.selectExpr("left_key", *[f"round(distance_{m}_{k}(a, b), 6) AS {m}_{k}" for m in _DENSE for k in _KINDS])


@query(f"""WITH {I8}, p AS (SELECT q.key AS left_key, q.v::DOUBLE[] AS a, x.v::DOUBLE[] AS b FROM i q JOIN i x ON x.key = q.key + 1)
SELECT left_key, round({L2.format(a='a', b='b')}, 6) + 0.0 AS sqeuclidean, round(CASE WHEN list_inner_product(a, b) = 0 THEN 0 ELSE {COS.format(a='a', b='b')} END, 6) + 0.0 AS cosine, {IP.format(a='a', b='b')} AS inner_,
 list_sum(list_transform(list_zip(a, b), lambda z: bit_count(xor(((z[1] + 256) % 256)::INTEGER, ((z[2] + 256) % 256)::INTEGER))))::DOUBLE AS hamming FROM p""")
def sql_distance_blobs(spark, sf_dir):
    """Binary 8-bit vectors, and the same bytes as bits."""
    register(spark)

    def blob(v):
        return F.unhex(F.array_join(F.transform(quantize.to_i8(v), lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))

    pairs = neighbours(spark, sf_dir, prepare=blob)
    return pairs.selectExpr("left_key", "round(distance_sqeuclidean_i8(a, b), 6) AS sqeuclidean", "round(distance_cosine_i8(a, b), 6) AS cosine", "distance_inner_i8(a, b) AS inner_", "distance_hamming_binary(a, b) AS hamming")


@query("""WITH c AS (SELECT c_custkey AS k, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer)
SELECT k, round(6371008.8 * 2 * asin(sqrt(least(1.0, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 3) + 0.0 AS meters FROM c""")
def sql_distance_haversine(spark, sf_dir):
    register(spark)
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "cast(c_custkey * 37 % 180 - 90 AS double) AS lat", "cast(c_custkey * 91 % 360 - 180 AS double) AS lon")
    return c.selectExpr("k", "round(distance_haversine_meters(lat, lon, 10D, 20D), 3) AS meters")


@query("SELECT vec_id AS key, generate_subscripts(embedding, 1)::INTEGER - 1 AS dim, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def table_round_trip(spark, sf_dir):
    """Saved as a vector table in the shared folder, and loaded as a view."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex[:12]}"
    by_id(spark, sf_dir).save(path)
    rows = VectorTable.load(spark, path, view=True).rows
    return rounded(rows.select("key", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.col("value").cast("double")), "value")


_F16 = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0)::DOUBLE * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"
_BF16 = "CASE WHEN x = 0 THEN 0 ELSE trunc(x / pow(2, floor(log2(abs(x))) - 7)) * pow(2, floor(log2(abs(x))) - 7) END"


def _cast_sql(value: str) -> str:
    return f"WITH u AS (SELECT vec_id AS key, generate_subscripts(embedding, 1)::INTEGER - 1 AS dim, unnest(embedding)::DOUBLE AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT key, dim, round(({value})::DOUBLE, 9) + 0.0 AS value FROM u"


def _cast(spark, sf_dir, *kinds: str):
    """From f32 through kinds, back as doubles."""
    x, before = vectors(spark, sf_dir).select("key", "vector"), "f32"
    for kind in (*kinds, "f64"):
        x, before = x.withColumn("vector", quantize.cast(F.col("vector"), before, kind, 64)), kind
    return x.select("key", F.posexplode("vector").alias("dim", "value")).select("key", "dim", F.round("value", 9).alias("value"))


@query(_cast_sql(_F16))
def quant_f16(spark, sf_dir):
    return _cast(spark, sf_dir, "f16")


@query(_cast_sql(_BF16))
def quant_bf16(spark, sf_dir):
    return _cast(spark, sf_dir, "bf16")


@query(_cast_sql("(trunc(x * 127 / n) / 127)::FLOAT"))
def quant_i8_back(spark, sf_dir):
    return _cast(spark, sf_dir, "i8")


@query(_cast_sql("CASE WHEN x > 0 THEN 1 ELSE 0 END"))
def quant_b1_back(spark, sf_dir):
    return _cast(spark, sf_dir, "f16", "b1")


@query("SELECT vec_id AS key, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) + 0.0 AS first FROM embeddings UNION ALL SELECT -1, 0.5")
def crud_update(spark, sf_dir):
    x = vectors(spark, sf_dir)
    new = x.filter("key % 3 = 0").select("key", F.transform("vector", lambda v: -v).alias("vector"))
    more = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("vector"))
    got = by_id(spark, sf_dir).update(new.unionByName(more), insert=True)
    return got.rows.select("key", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT count(*) AS n, min(key) AS first, max(key) AS last, count(DISTINCT key) AS keys FROM (SELECT vec_id AS key FROM embeddings UNION ALL SELECT vec_id + (SELECT count(*) FROM embeddings) FROM embeddings)")
def crud_append(spark, sf_dir):
    t = by_id(spark, sf_dir)
    return t.append(vectors(spark, sf_dir).select("vector")).rows.agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.countDistinct("key").alias("keys"))


@query(f"WITH {E} SELECT q.key AS query_id, x.label::BIGINT AS key, count(*) AS n, round(avg({at(COS)}), 6) + 0.0 AS mean, round(min({at(COS)}), 6) + 0.0 AS min, round(max({at(COS)}), 6) + 0.0 AS max FROM e q JOIN e x ON x.label = q.key // 50 % 10 WHERE q.key % 50 = 0 GROUP BY 1, 2")
def key_distances(spark, sf_dir):
    """Every query vector to a label, a key of many vectors."""
    q = queries_of(vectors(spark, sf_dir))
    pairs = q.select("query_id", (F.floor(F.col("query_id") / 50) % 10).alias("key"))
    return rounded(by_label(spark, sf_dir).distances(q, pairs), "mean", "min", "max")


@query(knn_sql(COS))
def merged_paths(spark, sf_dir):
    """Four saved tables searched as one."""
    x, base = vectors(spark, sf_dir), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex[:12]}"
    for i in range(4):
        VectorTable(Config(64), x.filter(F.col("key") % 4 == i).select("key", "vector")).save(f"{base}/{i}")
    return rounded(VectorTable.merge_paths(spark, [f"{base}/{i}" for i in range(4)]).search(queries_of(x), K))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS key, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def matrix_round_trip(spark, sf_dir):
    """Written as matrix files in the shared folder, and read back by row ranges."""
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex[:12]}"
    save_matrix(vectors(spark, sf_dir).select("key", "vector"), path)
    rows = load_matrix(spark, path, rows_a_task=100)
    return rows.select("key", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT range AS key, 1.0::DOUBLE AS norm, 32::INTEGER AS ndim FROM range(1000)")
def generated_vectors(spark, sf_dir):
    v = F.col("vector")
    return random_vectors(spark, 1000, 32).select("key", F.round(F.sqrt(metrics.dot(v, v)), 6).alias("norm"), F.size(v).alias("ndim"))


@query("SELECT vec_id AS key, count(*) OVER () * (8 + 64 * 4) AS bytes FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT NULL, 0")
def table_sizes(spark, sf_dir):
    """Bytes of a table of the queries, of which a fork has none."""
    t = by_id(spark, sf_dir)
    t = VectorTable(t.config, t.rows.filter("key % 50 = 0"))
    return t.rows.select("key", F.lit(t.memory_usage()).cast("long").alias("bytes")).unionByName(spark.createDataFrame([(None, t.fork().memory_usage())], "key long, bytes long"))


@query(f"WITH {E} SELECT q.key AS query_id, x.key, round({at(COS)}, 6) + 0.0 AS distance FROM e q JOIN e x ON q.label = x.label WHERE q.key % 50 = 0 AND {at(COS)} <= 0.8")
def within_radius(spark, sf_dir):
    """The stream-to-table neighbours on a table: queries against the rows of their own label."""
    x = vectors(spark, sf_dir)
    found = within(x.filter("key % 50 = 0").withColumnRenamed("key", "query_id"), x, "label", 0.8)
    return rounded(found)
