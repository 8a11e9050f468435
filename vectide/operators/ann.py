"""Approximate search by inverted lists: centroids, a bucket for each vector, an equi-join on buckets, exact distances.

Centroids are fitted on a bounded seeded sample; every row is indexed. A query probes its `probes` nearest lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.metrics import ALIASES, metric
from vectide.operators.cluster import assign, kmeans
from vectide.operators.knn import BLOCK, MATRIX, distances, least, matrix, query_blocks, ranked

SAMPLE = 20_000


def build(points: DataFrame, lists: int, kind: str = "cos", sample: int = SAMPLE, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(key, vector, bucket) of all points, a row for each, and the centroids."""
    fitted = points.filter("vector IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "key", "vector")).limit(sample).persist()
    _, centroids = kmeans(fitted.select("key", "vector"), lists, kind, seed=seed, max_iterations=5)
    fitted.unpersist()
    return assign(points, centroids, kind, "vector").select("key", "vector", F.col("cluster").alias("bucket")), centroids


def probed(queries: DataFrame, centroids: np.ndarray, probes: int, kind: str = "cos") -> DataFrame:
    """(query_id, q, bucket): a row for each of a query's `probes` nearest lists."""

    def probe(batches):
        for b in batches:
            near = np.argsort(distances(kind, matrix(b.column(1), centroids.shape[1]), centroids), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel(), pa.int32())], names=["query_id", "q", "bucket"])

    rows = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("q"))
    return rows.mapInArrow(probe, f"query_id {dict(queries.dtypes)['query_id']}, q array<double>, bucket int")


def _probe_knn(ids: np.ndarray, q: np.ndarray, lists: dict[int, np.ndarray], kind: str, k: int):
    """mapInArrow over (key, vector, bucket): candidates of each query; lists: the queries that probe a bucket."""

    def run(batches):
        best, known = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for b in batches:
            bucket = b.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else []
            x, key = matrix(b.column(1), q.shape[1]), b.column(0).to_numpy(zero_copy_only=False)
            for start, stop in zip(cuts, cuts[1:], strict=False):
                rows, asked = order[start:stop], lists.get(int(bucket[order[start]]))
                if asked is not None:
                    d = np.concatenate([best[asked], distances(kind, q[asked], x[rows])], axis=1)
                    names = np.concatenate([known[asked], np.broadcast_to(key[rows], (len(asked), len(rows)))], axis=1)
                    best[asked], known[asked] = least(d, names, k)
        at, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(known[at, place]), pa.array(best[at, place])], names=["query_id", "key", "distance"])

    return run


def search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int, kind: str = "cos") -> DataFrame:
    """(query_id, rank, key, distance) among the vectors of each query's `probes` nearest lists; all lists give the exact result.

    As in knn.search a block of queries is broadcast; a task multiplies the vectors of a list with the queries that probe
    it, and reads no lists that none of the block probes. Metrics without a matrix form join queries and lists on the bucket."""
    name = ALIASES.get(kind, kind)
    if name not in MATRIX:
        pairs = probed(queries, centroids, probes, kind).join(index, "bucket").select("query_id", "key", metric(kind)(F.col("q"), F.col("vector")).alias("distance"))
        return ranked(pairs, k).select("query_id", "rank", "key", "distance")
    parts = []
    for ids, q in query_blocks(queries.filter("vector IS NOT NULL"), BLOCK):
        near = np.argsort(distances(name, np.asarray(q, dtype=float), centroids), axis=1, kind="stable")[:, :probes]
        lists = {int(b): np.flatnonzero((near == b).any(axis=1)) for b in np.unique(near)}
        rows = index.filter(F.col("bucket").isin([int(b) for b in lists])) if len(lists) < len(centroids) else index
        parts.append(rows.select(F.col("key").cast("long"), F.col("vector").cast("array<double>"), "bucket").mapInArrow(_probe_knn(ids, np.asarray(q, dtype=float), lists, name, k), "query_id long, key long, distance double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, key long, distance double")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return ranked(pairs, k).select("query_id", "rank", "key", "distance")


def search_once(queries: DataFrame, vectors: DataFrame, k: int, kind: str = "cos", expansion: int = 64, lists: int | None = None) -> DataFrame:
    """Approximate search without an index that is kept: build, then search. expansion: vectors a query should meet, in units of k."""
    n = vectors.filter("vector IS NOT NULL").count()
    lists = lists or max(2, min(n - 1, round(n**0.5)))
    index, centroids = build(vectors, lists, kind)
    return search(queries, index, centroids, k, max(1, min(lists, round(expansion * k * lists / n))), kind)


def efficiency(queries: DataFrame, index: DataFrame, centroids: np.ndarray, probes: int, kind: str = "cos") -> float:
    """1 less the share of all distances that a search computes, those to centroids included."""
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n"))

    met = probed(queries, centroids, probes, kind).join(sizes, "bucket").agg(F.sum("n")).first()[0] or 0
    n, total = queries.count(), index.count()
    return 1 - (met + n * len(centroids)) / max(1, n * total)
