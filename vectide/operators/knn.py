"""Nearest neighbours: a query set against all rows, in blocks.

A block of at most `block` queries is broadcast (its size is fixed by the parameter), each task multiplies its batches
of vectors with the block in numpy and keeps k candidates a query, and a window over those ranks the result by
(distance, key). Nothing but the candidates is shuffled: k rows a query (and group) and task. Metrics without a matrix form
use the Column expression with the same plan shape. Null vectors are in no result; vectors of different lengths
raise. Filters go below the ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vectide.functions.metrics import ALIASES, metric

BLOCK = 4096
#: Distances that a worker holds at once.
CELLS = 1 << 20
MATRIX = ("ip", "cos", "l2sq")


def distances(kind: str, q: np.ndarray, x: np.ndarray, xx: np.ndarray | None = None) -> np.ndarray:
    """queries x rows; xx: the rows' sums of squares, where they are known."""
    ab = q @ x.T
    if kind == "ip":
        return 1 - ab
    qq, xx = (q * q).sum(axis=1)[:, None], ((x * x).sum(axis=1) if xx is None else xx)[None, :]
    if kind == "l2sq":
        d = qq + xx
        ab *= 2
        d -= ab
        return np.maximum(d, 0, out=d)
    scale = np.sqrt(qq) * np.sqrt(xx)
    if scale.all():
        ab /= scale
        return np.subtract(1, ab, out=ab)
    return np.where(scale > 0, 1 - ab / np.where(scale > 0, scale, 1), np.where((qq == 0) & (xx == 0), 0.0, 1.0))


def matrix(vectors: pa.Array, ndim: int | None = None) -> np.ndarray:
    """rows x dimensions; rows of other lengths raise."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(n) and ((n != n[0]).any() or ndim is not None and n[0] != ndim):
        raise ValueError(f"vectors have different numbers of dimensions: {sorted({*n.tolist(), *([] if ndim is None else [ndim])})}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), -1) if len(n) else np.zeros((0, ndim or 0))


def least(d: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by (distance, key); keys has d's shape."""
    if d.shape[1] <= 4 * k:
        order = np.lexsort((keys, d), axis=1)[:, :k]
        return np.take_along_axis(d, order, axis=1), np.take_along_axis(keys, order, axis=1)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out, names = np.empty((len(d), k)), np.empty((len(d), k), dtype=np.int64)
    for i in range(len(d)):
        at = np.flatnonzero(d[i] <= edge[i])  # k, and what is as far as the last
        at = at[np.lexsort((keys[i, at], d[i, at]))[:k]]
        out[i], names[i] = d[i, at], keys[i, at]
    return out, names


class Least:
    """The k first of each of n queries by (distance, key), from any number of parts; little more than these are held."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.parts, self.size = n, k, [], 0
        self.edge, self.last = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)  # each query's k-th so far

    def add(self, d: np.ndarray, keys: np.ndarray) -> None:
        """d: queries x keys."""
        edge, last = self.edge, self.last
        if d.shape[1] > 4 * self.k and np.isinf(edge).any():
            first = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
            edge, last = np.where(first < edge, first, edge), np.where(first < edge, np.iinfo(np.int64).max, last)
        in_, tie = ~(d >= edge[:, None]), d == edge[:, None]
        if tie.any():
            in_ |= tie & (keys[None, :] < last[:, None])
        q, x = np.nonzero(in_)
        if len(q):
            self.parts.append((q, keys[x], d[q, x]))
            self.size += len(q)
        if self.size > 2 * self.n * self.k or np.isinf(self.edge).any() and self.size >= self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, distance) of the k first of each query, which alone stay."""
        if not self.parts:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=np.int64), np.zeros(0)
        q, keys, d = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((keys, d, q))
        start = np.searchsorted(q[order], np.arange(self.n + 1))
        order = order[np.arange(len(order)) - start[q[order]] < self.k]
        q, keys, d = q[order], keys[order], d[order]
        full = np.flatnonzero(np.diff(start) >= self.k)
        at = np.searchsorted(q, full) + self.k - 1
        self.edge[full], self.last[full] = d[at], keys[at]
        self.parts, self.size = [(q, keys, d)], len(q)
        return q, keys, d


def _block_knn(ids: np.ndarray, q: np.ndarray, kind: str, k: int, group: pa.DataType | None = None):
    """mapInArrow over (key, vector[, group]): candidates of each query, and of each group if there is a third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        step = max(16, CELLS // len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, key = matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(zero_copy_only=False)
            codes = batch.column(2).dictionary_encode(null_encoding="encode") if batch.num_columns > 2 else None
            names = codes.dictionary.to_pylist() if codes is not None else [None]
            code = codes.indices.to_numpy() if codes is not None else np.zeros(len(x), dtype=int)
            for g, name in enumerate(names):
                rows = np.flatnonzero(code == g)
                found = best.setdefault(name, Least(len(ids), k))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    found.add(distances(kind, q, x[part]), key[part])
        for name, found in best.items():
            of, known, d = found.cut()
            columns = [pa.array(ids[of]), pa.array(known), pa.array(d)]
            if group is not None:
                columns.append(pa.array([name] * len(of), type=group))
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "distance", "per"][: len(columns)])

    return run


def ranked(pairs: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k rows (query_id, key, distance) of each group by (distance, key), with their rank from 1."""
    w = Window.partitionBy(*by).orderBy("distance", "key")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(
    queries: DataFrame, vectors: DataFrame, k: int, kind: str | Callable = "cos", *, where: Column | None = None, radius: float | None = None,
    exclude_self: bool = False, per: str | None = None, block: int = BLOCK, native: bool = False,
) -> DataFrame:
    """(query_id, rank, key, distance[, per]) of the k nearest vectors of each query.

    queries (query_id, vector), vectors (key, vector, ...); where: a predicate over vectors' columns, applied before
    the ranking; radius: the largest distance; per: k for each value of that column; native: the Column expression
    instead of numpy (the same rows). k above the number of vectors returns all."""
    if k <= 0:
        raise ValueError("k must be positive")
    x = vectors.filter("vector IS NOT NULL")
    x = x.filter(where) if where is not None else x
    groups = ["query_id"] + ([per] if per else [])
    name = ALIASES.get(kind, kind) if isinstance(kind, str) else None
    more = int(exclude_self)
    parts = []
    for ids, q in query_blocks(queries.filter("vector IS NOT NULL"), block):
        if name in MATRIX and not native:
            schema = "query_id long, key long, distance double" + (f", per {dict(x.dtypes)[per]}" if per else "")
            group = to_arrow_type(x.schema[per].dataType) if per else None
            found = x.select(F.col("key").cast("long"), F.col("vector").cast("array<double>"), *groups[1:]).mapInArrow(_block_knn(ids, np.asarray(q, dtype=float), name, k + more, group), schema)
            parts.append(found.withColumnRenamed("per", per) if per else found)
        else:
            small = F.broadcast(queries.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q, strict=True)], f"query_id long, q {dict(vectors.dtypes)['vector']}"))
            pairs = x.join(small, F.lit(True)).select("query_id", "key", metric(kind)(F.col("q"), F.col("vector")).alias("distance"), *groups[1:])
            parts.append(pairs)
    if not parts:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, key long, distance double")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    if exclude_self:
        pairs = pairs.filter("key <> query_id")
    if radius is not None:
        pairs = pairs.filter(F.col("distance") <= radius)
    return ranked(pairs, k, tuple(groups)).select("query_id", "rank", "key", "distance", *groups[1:])


def near(queries: DataFrame, vectors: DataFrame, bucket: str, radius: float, kind: str = "cos") -> DataFrame:
    """(query_id, key, distance) of all vectors of a query's bucket within radius; kind: one with a matrix form.

    The queries are taken in the order of their buckets, so that most blocks meet few of them; nothing is shuffled."""
    kinds, name = dict(vectors.dtypes), ALIASES.get(kind, kind)
    x = vectors.filter(f"vector IS NOT NULL AND `{bucket}` IS NOT NULL").select("key", F.col("vector").cast("array<double>"), bucket)
    asked = queries.filter(f"vector IS NOT NULL AND `{bucket}` IS NOT NULL").select(F.struct(F.col(bucket).cast(kinds[bucket]).alias("bucket"), "query_id").alias("query_id"), "vector")
    ids_kind = dict(queries.dtypes)["query_id"]
    parts = []
    for ids, q in query_blocks(asked, BLOCK):
        of: dict = {}
        for i, (b, _) in enumerate(ids):
            of.setdefault(b, []).append(i)
        names = pa.array([i[1] for i in ids], to_arrow_type(queries.schema["query_id"].dataType))

        def run(batches, of={b: np.array(i) for b, i in of.items()}, q=np.asarray(q, dtype=float), names=names):
            for batch in batches:
                codes = batch.column(2).dictionary_encode()
                code = codes.indices.to_numpy(zero_copy_only=False)
                x = matrix(batch.column(1), q.shape[1])
                for g, b in enumerate(codes.dictionary.to_pylist()):
                    at, rows = of.get(b), np.flatnonzero(code == g)
                    if at is None:
                        continue
                    step = max(16, CELLS // 4 // len(at))
                    for start in range(0, len(rows), step):
                        part = rows[start : start + step]
                        d = distances(name, q[at], x[part])
                        i, j = np.nonzero(d <= radius)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at[i])), batch.column(0).take(pa.array(part[j])), pa.array(d[i, j])], names=["query_id", "key", "distance"])

        rows = x.filter(F.col(bucket).isin(list(of))) if len(of) <= 100 else x
        parts.append(rows.mapInArrow(run, f"query_id {ids_kind}, key {kinds['key']}, distance double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query_id {ids_kind}, key {kinds['key']}, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries, in order. All blocks are in the plan that uses them, so a query set has to fit the driver. An id of several columns stays a row."""
    ids, rows, named = [], [], list if queries.schema["query_id"].dataType.typeName() == "struct" else np.array
    for r in queries.select("query_id", "vector").orderBy("query_id").toLocalIterator():
        if rows and len(r.vector) != len(rows[0]):
            raise ValueError(f"vectors have different numbers of dimensions: {sorted({len(r.vector), len(rows[0])})}")
        ids.append(r.query_id)
        rows.append(r.vector)
        if len(ids) == block:
            yield named(ids), np.array(rows)
            ids, rows = [], []
    if ids:
        yield named(ids), np.array(rows)


def sharded(queries: DataFrame, shards: list[DataFrame], k: int, kind: str = "cos") -> DataFrame:
    """Search a list of shards (key, vector) as one: their rows together; keys that several shards hold stay apart."""
    all_rows = shards[0]
    for s in shards[1:]:
        all_rows = all_rows.unionByName(s)
    return search(queries, all_rows, k, kind)


def pairwise(left: DataFrame, right: DataFrame, pairs: DataFrame, kind: str = "cos") -> DataFrame:
    """(left_key, right_key, n, mean, min, max) over all vectors of each pair of keys; a missing key: n is 0, the rest null."""
    a = left.select(F.col("key").alias("left_key"), F.col("vector").alias("a"))
    b = right.select(F.col("key").alias("right_key"), F.col("vector").alias("b"))
    d = pairs.join(a, "left_key", "left").join(b, "right_key", "left").withColumn("d", metric(kind)(F.col("a"), F.col("b")))
    return d.groupBy("left_key", "right_key").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"))


def key_distances(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, kind: str = "cos") -> DataFrame:
    """(query_id, key, n, mean, min, max) of each query vector to all vectors of a key; pairs (query_id, key). A missing key: n is 0, the rest null.

    With a matrix form and whole keys, blocks of pairs are broadcast as in a search, in the order of their keys; a task sums up its rows for
    each pair of the block, and only those sums are shuffled. Queries and pairs have to fit the driver."""
    name, whole = ALIASES.get(kind, kind) if isinstance(kind, str) else None, ("tinyint", "smallint", "int", "bigint")
    if name not in MATRIX or not {dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["key"], *dict(pairs.dtypes).values()} <= {*whole}:
        q = queries.select(F.col("query_id").alias("left_key"), "vector").withColumnRenamed("left_key", "key")
        found = pairwise(q, vectors, pairs.select(F.col("query_id").alias("left_key"), F.col("key").alias("right_key")), kind)
        return found.withColumnsRenamed({"left_key": "query_id", "right_key": "key"})
    x = vectors.filter("vector IS NOT NULL").select(F.col("key").cast("long"), F.col("vector").cast("array<double>"))
    parts = [pairs.select("query_id", "key", F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("total", "min", "max")])]
    asked = pairs.join(queries.filter("vector IS NOT NULL"), "query_id").filter("key IS NOT NULL").select(F.struct("key", "query_id").alias("query_id"), "vector")
    for ids, q in query_blocks(asked, BLOCK):
        keys, names = (np.array([i[c] for i in ids], dtype=np.int64) for c in (0, 1))
        parts.append(x.filter(F.col("key").between(int(keys[0]), int(keys[-1]))).mapInArrow(_key_sums(keys, names, np.asarray(q, dtype=float), name), "query_id long, key long, n long, total double, min double, max double"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = every.groupBy("query_id", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"))
    kinds = dict(pairs.dtypes)
    return sums.select(F.col("query_id").cast(kinds["query_id"]), F.col("key").cast(kinds["key"]), "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "min", "max")


def _key_sums(keys: np.ndarray, names: np.ndarray, q: np.ndarray, kind: str):
    """mapInArrow over (key, vector): number, sum, least and largest of the distances of each pair; keys ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys)), np.full(len(keys), np.nan), np.full(len(keys), -np.inf)
        for batch in batches:
            x, key = matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True]) if len(order) else []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                here = slice(*(int(np.searchsorted(keys, key[order[start]], side)) for side in ("left", "right")))
                step = max(16, CELLS // max(1, here.stop - here.start))
                for at in range(start, stop, step) if here.stop > here.start else ():
                    d = distances(kind, q[here], x[order[at : min(at + step, stop)]])
                    n[here] += d.shape[1]
                    total[here] += d.sum(axis=1)
                    low[here], high[here] = np.fmin(low[here], np.fmin.reduce(d, axis=1)), np.maximum(high[here], d.max(axis=1))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (names, keys, n, total, low, high)], names=["query_id", "key", "n", "total", "min", "max"])

    return run
