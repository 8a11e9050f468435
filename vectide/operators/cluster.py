"""Clustering: k-means, and nearest members of sampled levels.

Levels need no graph: a key's level is floor(-ln(u) / ln(connectivity)), u an arithmetic hash of the key, so level L
holds about connectivity**-L of the rows, the same on every run."""

from __future__ import annotations

import heapq
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.metrics import metric
from vectide.operators.knn import distances, matrix, query_blocks
from vectide.sources.folder import forget, written

#: Rows and centroids of the largest matrix of distances in a worker.
TILE = 512, 1024
#: Members that a worker holds.
MEMBERS = 32_768


def _nearest(x: np.ndarray, centroids: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lowest number on ties, and the distance; tile by tile, whatever the numbers of both."""
    at, least = np.zeros(len(x), dtype=int), np.zeros(len(x))
    for i in range(0, len(x), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(0, len(centroids), TILE[1]):
            d = distances(kind, x[rows], centroids[j : j + TILE[1]])
            first = d.argmin(axis=1)
            d = d[np.arange(len(d)), first]
            if j == 0:
                at[rows], least[rows] = first, d
            else:
                nearer = d < least[rows]
                at[rows], least[rows] = np.where(nearer, first + j, at[rows]), np.where(nearer, d, least[rows])
    return at, least


def assign(points: DataFrame, centroids: np.ndarray, kind: str = "l2sq", *more: str) -> DataFrame:
    """(key, cluster, distance[, more columns of points]), a row for each point: the nearest centroid, the lowest number on ties.

    centroids: k x dimensions, broadcast."""

    def nearest(batches):
        for b in batches:
            at, d = _nearest(matrix(b.column(1), centroids.shape[1]), centroids, kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d, pa.float64()), *b.columns[2:]], names=["key", "cluster", "distance", *more])

    kinds = dict(points.dtypes)
    rows = points.filter("vector IS NOT NULL").select("key", F.col("vector").cast("array<double>").alias("x"), *more)
    return rows.mapInArrow(nearest, f"key {kinds['key']}, cluster int, distance double" + "".join(f", `{c}` {kinds[c]}" for c in more))


def update(assigned: DataFrame, kind: str = "l2sq") -> DataFrame:
    """(cluster, dim, value) from (cluster, vector): means of the members for l2sq, sums of unit length for cos, else sums."""

    def sums(batches):
        total, n = {}, {}
        for b in batches:
            x, c = matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(c).tolist():
                total[k], n[k] = total.get(k, 0) + x[c == k].sum(axis=0), n.get(k, 0) + int((c == k).sum())
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v), pa.array([n[k]] * len(v), pa.int64())], names=["cluster", "dim", "total", "n"])

    by_task = assigned.select("cluster", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(sums, "cluster int, dim int, total double, n long")
    both = by_task.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    if kind != "cos":
        return both.select("cluster", "dim", (F.col("total") / (F.col("n") if kind == "l2sq" else F.lit(1))).alias("value"))
    norm = both.groupBy("cluster").agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("norm"))
    return both.join(norm, "cluster").select("cluster", "dim", F.when(F.col("norm") > 0, F.col("total") / F.col("norm")).otherwise(0.0).alias("value"))


def starts(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k different rows by a seeded hash of their vectors; fewer if there are no more."""
    rows = points.filter("vector IS NOT NULL").select("vector").distinct().orderBy(F.xxhash64(F.lit(seed), "vector")).limit(k).collect()
    return np.array([r.vector for r in rows], dtype=float)


def kmeans(
    points: DataFrame, k: int, kind: str = "l2sq", max_iterations: int = 20, inertia_threshold: float = 1e-4, min_shifts: float = 0.01, seed: int = 0,
    max_seconds: float | None = None, prepare=None, first: np.ndarray | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Assignments (key, cluster, distance), a row for each point, and the k x dimensions centroids; points (key, vector).

    Ends after max_iterations, max_seconds, a relative change of the distances' sum of at most inertia_threshold, or at most
    min_shifts of the points changing sides. prepare: a cast of the vectors (Column -> Column) that goes first; first:
    the starting centroids. An emptied cluster becomes the zero vector. A round is one pass: each task sums its points by
    cluster, counts those that the last centroids had elsewhere, and k x dimensions sums a task are shuffled."""
    if prepare is not None:
        points = points.withColumn("vector", prepare(F.col("vector")))
    points = points.filter("vector IS NOT NULL")
    n = points.count()
    if not 2 <= k < n:
        raise ValueError("k must be from 2 to fewer than the points")
    centroids, old, last, began = starts(points, k, seed) if first is None else first, None, None, time.monotonic()

    def sums(batches):
        total, size = np.zeros((len(centroids), centroids.shape[1])), np.zeros(len(centroids), dtype=np.int64)
        inertia, shifted = 0.0, 0
        for b in batches:
            x = matrix(b.column(0), centroids.shape[1])
            at, d = _nearest(x, centroids, kind)
            inertia += float(d.sum())
            shifted += len(x) if old is None else int((at != _nearest(x, old, kind)[0]).sum())
            size += np.bincount(at, minlength=len(size))
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(x) else []
            if len(x):
                total[at[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
        c, dim = np.nonzero(np.broadcast_to(size[:, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[c, -1, -2], pa.int32()), pa.array(np.r_[dim, 0, 0], pa.int32()), pa.array(np.r_[total[c, dim], inertia, shifted]), pa.array(np.r_[size[c], 0, 0], pa.int64())], names=["cluster", "dim", "total", "n"])

    for _ in range(max_iterations):
        rows = points.select(F.col("vector").cast("array<double>")).mapInArrow(sums, "cluster int, dim int, total double, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        inertia, shifted = (sum(r.total for r in rows if r.cluster == c) for c in (-1, -2))
        if last is not None and (abs(last - inertia) <= inertia_threshold * max(last, 1e-12) or shifted <= min_shifts * n):
            break
        if max_seconds is not None and time.monotonic() - began > max_seconds:
            break
        new = np.zeros_like(centroids)
        for r in rows:
            if r.cluster >= 0:
                new[r.cluster, r.dim] = r.total / r.n if kind == "l2sq" else r.total
        if kind == "cos":
            length = np.sqrt((new * new).sum(axis=1, keepdims=True))
            new = np.divide(new, length, out=np.zeros_like(new), where=length > 0)
        last, old, centroids = inertia, centroids, new
    return assign(points, centroids, kind), centroids


def level(key: Column, connectivity: int = 16) -> Column:
    """The level of a key, from 0 on."""
    word, factor = F.lit(4294967296), F.lit(2654435761)
    x = F.pmod(key, word) + 1
    high, low = F.floor(x / 65536).cast("long"), F.pmod(x, F.lit(65536))  # in halves, so that products stay below 2**63
    u = (F.pmod(F.pmod(high * factor, word) * 65536 + low * factor, word) + 0.5) / 4294967296.0
    return F.floor(-F.ln(u) / F.ln(F.lit(float(connectivity)))).cast("int")


def level_stats(points: DataFrame, connectivity: int = 16) -> DataFrame:
    """(level, nodes, edges, max_edges): level L counts the keys of level L or higher.

    edges are those of the graph that links each node of a level to its nearest `connectivity` others (twice as many on level 0), or
    to all others where there are fewer; max_edges is what the lists hold when full."""
    counts = points.groupBy(level(F.col("key"), connectivity).alias("top")).count()
    nodes = counts.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"), "count").groupBy("level").agg(F.sum("count").alias("nodes"))
    most = F.when(F.col("level") == 0, 2 * connectivity).otherwise(connectivity)
    return nodes.select("level", "nodes", (F.col("nodes") * F.least(most, F.col("nodes") - 1)).alias("edges"), (F.col("nodes") * most).alias("max_edges"))


def cluster_by_level(points: DataFrame, at: int, kind: str = "cos", connectivity: int = 16) -> DataFrame:
    """(key, centroid, distance): each point's nearest member of a level, ties by the member's key.

    The members are about connectivity**-at of the points. With more than one block of them, a row takes the least of its blocks
    by its key and vector, so rows with one key stay apart."""
    return _by_level(points, at, kind, connectivity)


def _by_level(points: DataFrame, at: int, kind: str, connectivity: int, *more: str) -> DataFrame:
    """cluster_by_level, with more columns; of them `vector` in double."""
    members = points.filter("vector IS NOT NULL").filter(level(F.col("key"), connectivity) >= max(at, 1)).select(F.col("key").alias("query_id"), "vector")
    parts = []
    names = ["key", "row", "centroid", "distance", *more]
    for ids, block in query_blocks(members, MEMBERS):

        def nearest(batches, ids=ids, block=np.asarray(block, dtype=float)):
            for b in batches:
                first, d = _nearest(matrix(b.column(1), block.shape[1]), block, kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids[first]), pa.array(d), *[b.column(1) for _ in more]], names=names)

        rows = points.filter("vector IS NOT NULL").select("key", F.col("vector").cast("array<double>"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.mapInArrow(nearest, "key long, row long, centroid long, distance double" + "".join(f", {c} array<double>" for c in more)))
    if not parts:
        raise ValueError("too few members to cluster")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("row") if len(parts) == 1 else out.groupBy("key", "row").agg(F.min(F.struct("distance", "centroid", *more)).alias("m")).select("key", "m.centroid", "m.distance", *[f"m.{c}" for c in more])


def merged(sizes: dict[int, int], vectors: dict[int, np.ndarray], most: int, kind: str) -> dict[int, int]:
    """centroid -> survivor. While there are more than `most`, the least popular (on ties the highest key) joins its nearest survivor, which takes over its members."""
    names = sorted(sizes)
    n, into, left = [sizes[c] for c in names], list(range(len(names))), len(names)
    heap = [(n[i], -names[i], i) for i in range(left)]
    heapq.heapify(heap)
    ids, x = np.arange(left), np.array([vectors[c] for c in names], dtype=float)  # the survivors, and some that are gone
    xx, place, there = (x * x).sum(axis=1), np.arange(left), np.ones(left, dtype=bool)
    while left > most:
        size, _, gone = heapq.heappop(heap)
        if into[gone] != gone or size != n[gone]:
            continue
        there[place[gone]] = False
        d = distances(kind, x[place[gone]][None, :], x, xx)[0]
        to = int(ids[np.where(there, d, np.inf).argmin()])
        into[gone] = to
        n[to] += n[gone]
        heapq.heappush(heap, (n[to], -names[to], to))
        left -= 1
        if left < 0.8 * len(ids):
            ids, x, xx = ids[there], x[there], xx[there]
            there = np.ones(left, dtype=bool)
            place[ids] = np.arange(left)

    def end(i: int) -> int:
        while into[i] != i:
            into[i] = into[into[i]]
            i = into[i]
        return i

    return {c: names[end(i)] for i, c in enumerate(names)}


def cluster(points: DataFrame, min_count: int = 0, max_count: int | None = None, kind: str = "cos", connectivity: int = 4) -> DataFrame:
    """(key, centroid, distance): each point's nearest member of the highest level with more than min_count members.

    If they have fewer than min_count centroids, one level down is taken, and so on to level 1. If they have more than max_count, the least popular is
    merged into its nearest until they haven't; a merged centroid can be merged again. Distances are to the centroid a point ends at.
    min_count 0: level 1, at least two, as many as it has. The members of the level chosen must fit the driver; that
    level is the smallest that serves. The nearest members are sought once, and kept in the shared folder."""
    stats = {r.level: r.nodes for r in level_stats(points, connectivity).collect()}
    if max(stats, default=0) < 2:
        raise ValueError("too few members to cluster")
    if min_count:
        at = next((lv for lv in sorted(stats, reverse=True) if lv > 1 and stats[lv] > min_count), 1)
    else:
        at, min_count, max_count = 1, 2, stats[1]
    while True:
        found = written(_by_level(points, at, kind, connectivity, "vector"), "nearest")
        sizes = {r.centroid: r["size"] for r in popularity(found).collect()}
        if len(sizes) >= min_count or at == 1:
            break
        forget(found)
        at -= 1
    if max_count is None or len(sizes) <= max_count:
        return found.drop("vector")
    members = points.filter("vector IS NOT NULL").filter(level(F.col("key"), connectivity) >= at).groupBy("key").agg(F.min("vector").alias("vector"))
    vectors = {r.key: np.array(r.vector, dtype=float) for r in members.collect() if r.key in sizes}
    ends = merged(sizes, vectors, max(1, max_count), kind)
    spark, last = points.sparkSession, sorted(set(ends.values()))
    names = spark.createDataFrame(pa.table({"centroid": pa.array(list(ends), pa.int64()), "last": pa.array(list(ends.values()), pa.int64())}))
    places = spark.createDataFrame([(int(c), vectors[c].tolist()) for c in last], "last long, at array<double>")
    rows = found.select("key", "centroid", "vector").join(F.broadcast(names), "centroid").join(F.broadcast(places), "last")
    return rows.select("key", F.col("last").alias("centroid"), metric(kind)(F.col("vector"), F.col("at")).alias("distance"))


def popularity(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("centroid").agg(F.count("*").alias("size"))


def members_of(clusters: DataFrame, centroid: int) -> DataFrame:
    return clusters.filter(F.col("centroid") == centroid)


def subcluster(points: DataFrame, clusters: DataFrame, centroid: int, **how) -> DataFrame:
    return cluster(points.join(members_of(clusters, centroid).select("key"), "key"), **how)


def network(points: DataFrame, clusters: DataFrame, kind: str = "cos") -> tuple[DataFrame, DataFrame]:
    """Nodes (centroid, size) and edges (a, b, distance) between all centroids, which max_count bounds.

    The edges are as many as pairs of centroids; a task makes those of 512 of them, a few tiles at once."""
    nodes = popularity(clusters)
    x = written(points.filter("vector IS NOT NULL").join(nodes.select(F.col("centroid").alias("key")), "key").select(F.col("key").cast("long"), F.col("vector").cast("array<double>")), "nodes")
    rows = x.repartition(max(1, -(-x.count() // TILE[0])))
    names, parts = ["a", "b", "distance"], []
    for ids, block in query_blocks(x.withColumnRenamed("key", "query_id"), MEMBERS):

        def edges(batches, ids=ids, block=np.asarray(block, dtype=float)):
            for b in batches:
                key, v = b.column(0).to_numpy(), matrix(b.column(1), block.shape[1])
                for i in range(0, len(key), 64):
                    for j in range(0, len(ids), TILE[1]):
                        p, q = np.nonzero(ids[j : j + TILE[1], None] < key[None, i : i + 64])
                        if len(p):
                            d = distances(kind, block[j : j + TILE[1]], v[i : i + 64])
                            yield pa.RecordBatch.from_arrays([pa.array(ids[j + p]), pa.array(key[i + q]), pa.array(d[p, q])], names=names)

        parts.append(rows.mapInArrow(edges, "a long, b long, distance double"))
    if not parts:
        return nodes, points.sparkSession.createDataFrame([], "a long, b long, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return nodes, out
