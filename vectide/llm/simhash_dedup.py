"""Near duplicates by SimHash fingerprints, linked through vantage-point trees.

Fingerprints: A-Z lower-cased, words split at ASCII white space, 4-word shingles (repeats included) hashed by
XXH64 with seed 42; a bit is set if more than half the hashes have it. A text of 1 to 3 words is one shingle; an
empty or null text has fingerprint zero and links like any other.

Linking works on distinct fingerprints, so exact copies cost nothing. Two fingerprints that differ in at most r bits
agree on at least b - r of any b disjoint blocks of bits. The Hamming distance restricted to a choice of b - r blocks
is a metric in which such a pair has distance 0, so a shard is a set of fingerprints at distance 0 from one vantage
point in that metric, for each choice. Each shard is searched in memory by a vantage-point tree that skips branches by
the triangle bound and those whose points all are linked already, and yields the edges of a spanning forest only.

A shard above `shard_rows` isn't random: many of its fingerprints are near each other, or share many bits. It is
contracted first. In each round about `hubs` points that no hub is near become hubs, and every point of the shard is linked to
all hubs within r; a hub then has all its links and leaves. If the other points end up in one component, nothing is
left to find. Otherwise they are cut into shards by more and narrower blocks.
Components: minimum-neighbour contraction with pointer jumping, each step a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vectide.llm.common import blocks, forget, written

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42


def fingerprint_of(text: str) -> int:
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        part = words[at : min(at + 8192, n) + SHINGLE_WORDS - 1]
        grams = zip(*(part[i:] for i in range(SHINGLE_WORDS)), strict=False) if len(part) >= SHINGLE_WORDS else [part]
        hashes = np.array([digest(join(g), SEED) for g in grams], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t) for block in blocks(texts) for t in block], type=pa.int64())


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint as a signed long."""
    return _fingerprint(text)


class VantageTree:
    """A vantage-point tree over unsigned 64-bit fingerprints; points that were found are left out of later answers."""

    LEAF = 256

    def __init__(self, points: np.ndarray):
        self.points, self.open = points, np.ones(len(points), dtype=bool)
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> list:
        """[number of open points, open points] of a leaf, [number, vantage, radius, inner, outer] of a branch."""
        if len(ids) > self.LEAF:
            vantage = self.points[ids[len(ids) // 2]]
            far = np.bitwise_count(self.points[ids] ^ vantage)
            radius = int(np.median(far))
            radius -= int(far.max()) <= radius
            inner = far <= radius
            if inner.any():
                return [len(ids), vantage, radius, self._build(ids[inner]), self._build(ids[~inner])]
        return [len(ids), ids]

    def take(self, point: np.uint64, r: int) -> np.ndarray:
        """The open points within r of point; they are closed from now on."""
        found: list[np.ndarray] = []
        self._take(self.root, point, r, found)
        ids = np.concatenate(found) if found else np.array([], dtype=int)
        self.open[ids] = False
        return ids

    def _take(self, node: list, point: np.uint64, r: int, found: list) -> int:
        if not node[0]:
            return 0
        if len(node) == 2:
            near = np.bitwise_count(self.points[node[1]] ^ point) <= r
            n = int(near.sum())
            if n:
                found.append(node[1][near])
                node[1] = node[1][~near]
        else:
            d, n = int(np.bitwise_count(node[1] ^ point)), 0
            if d - r <= node[2]:
                n += self._take(node[3], point, r, found)
            if d + r > node[2]:
                n += self._take(node[4], point, r, found)
        node[0] -= n
        return n


def forest(points: np.ndarray, r: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links points (distinct, uint64) within r bits."""
    tree = VantageTree(points)
    for start in range(len(points)):
        if not tree.open[start]:
            continue
        queue = [start]
        while queue and tree.root[0]:
            at = queue.pop()
            for to in tree.take(points[at], r).tolist():
                if to != at:
                    yield at, to
                    queue.append(to)


def _shard_edges(r: int, small: int = 48):
    """mapInArrow over rows (shard, fp) sorted by shard; edges (a, b) with a < b as signed longs."""

    def edges(shard: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        sizes = np.diff(np.r_[starts, len(shard)])
        u = fp.view(np.uint64)
        a, b = [], []
        own = np.repeat(sizes, sizes)
        for step in range(1, int(min(small, sizes.max(initial=0)))):  # all small shards at once
            i = np.flatnonzero((shard[step:] == shard[:-step]) & (own[step:] <= small))
            i = i[np.bitwise_count(u[i] ^ u[i + step]) <= r]
            a.append(fp[i])
            b.append(fp[i + step])
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            pairs = np.array(list(forest(u[s : s + n], r)), dtype=np.int64).reshape(-1, 2)
            a.append(fp[s + pairs[:, 0]])
            b.append(fp[s + pairs[:, 1]])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = np.minimum(a, b), np.maximum(a, b)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0  # batches from the start of the shard that may go on
        for batch in batches:
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(shard):
                continue
            if n > 200_000 and kept[0][0][0] != shard[-1]:
                cut = int(np.searchsorted(shard, shard[-1]))
                kept.append((shard[:cut], fp[:cut]))
                whole, points = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
                done = len(whole) if cut else int(np.searchsorted(whole, shard[-1]))
                yield from edges(whole[:done], points[:done])
                kept, n = [(whole[done:], points[done:])] if done < len(whole) else [], len(whole) - done
                shard, fp = shard[cut:], fp[cut:]
            kept.append((shard, fp))
            n += len(shard)
        if kept:
            yield from edges(*(np.concatenate([k[i] for k in kept]) for i in (0, 1)))

    return run


def _choices(n: int, r: int, more: int = 0) -> list[int]:
    """Bit masks: each pair within r bits agrees on all bits of at least one. More rows, or `more` blocks: more bits a mask."""
    total = (r + 1 if n <= 1 << 20 else r + 2 if n <= 1 << 27 else r + 3) + more
    edges = [round(64 * i / total) for i in range(total + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(total)]
    return [sum(block[i] for i in c) for c in combinations(range(total), total - r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sharded(points: DataFrame, masks: list[int], *within: str) -> DataFrame:
    """(shard, fp): each fingerprint once for each mask, with those that agree on it (and on the columns `within`)."""
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)]))
    shard = F.xxhash64("c.i", *within, F.col("fp").bitwiseAND(F.col("c.m")))
    return points.select("fp", *within, choice.alias("c")).select(shard.alias("shard"), "fp")


def _contract(dense: DataFrame, r: int, hubs: int, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """Edges of the points (shard, fp) to the hubs of their shard, and the points between which links may be left."""
    state, edges, before = written(dense.select("shard", "fp", F.lit(True).alias("open")), "dense"), None, None
    for turn in range(rounds):
        sizes = written(state.filter("open").groupBy("shard").agg(F.count("*").alias("n")), "open")
        total = sizes.agg(F.sum("n")).first()[0]
        if not total or before is not None and total > 0.9 * before:
            break
        before = total
        chance = F.when(F.col("n") <= 4 * hubs, 1.0).otherwise(hubs / F.col("n"))
        picked = state.filter("open").join(sizes, "shard").filter(F.pmod(F.xxhash64(F.lit(turn), "fp"), F.lit(1 << 30)) < chance * (1 << 30))
        picked = written(picked.groupBy("shard").agg(F.collect_list("fp").alias("hubs")), "hubs")  # about `hubs` a shard, at most 4 * hubs of few
        near = F.filter(F.coalesce("hubs", F.array().cast("array<long>")), lambda h: F.bit_count(F.col("fp").bitwiseXOR(h)) <= r)
        linked = written(state.join(picked, "shard", "left").withColumn("near", near).select("shard", "fp", (F.col("open") & (F.size("near") == 0)).alias("open"), "near"), "linked")
        new = linked.select("fp", F.explode("near").alias("hub")).filter("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
        edges = new if edges is None else edges.unionByName(new)
        forget(state)
        state = written(linked.filter(~F.array_contains("near", F.col("fp"))).select("shard", "fp", "open"), "dense")
    if edges is None:
        return None, state.select("shard", "fp")
    edges = written(edges, "stars")
    rest = state.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("shard", "fp", F.coalesce("root", "fp").alias("root"))
    apart = rest.groupBy("shard").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("shard")
    return edges, written(rest.join(apart, "shard").select("shard", "fp"), "rest")


def link(distinct: DataFrame, n: int, r: int = RADIUS, shard_rows: int = 20_000, hubs: int = 128, rounds: int = 6) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fp within r bits. distinct: one column fp, n rows.

    After the narrowest blocks a shard still above shard_rows is searched as it is, in one task, at 8 bytes a row."""
    points, stars = _sharded(distinct, _choices(n, r)), []
    if n > shard_rows:  # else no shard can be too large
        for more in (1, 3):
            large = written(points.groupBy("shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > shard_rows).select("shard"), "large-shards")
            if large.isEmpty():
                break
            edges, rest = _contract(points.join(large, "shard"), r, hubs, rounds)
            stars += [edges] if edges is not None else []
            points = written(points.join(large, "shard", "left_anti").unionByName(_sharded(rest, _choices(n, r, more), "shard")), "shards")
    out = points.distinct().repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_edges(r), "a long, b long")
    for s in stars:
        out = out.unionByName(s)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): the root is one node of each connected component."""
    edges = written(edges.select("a", "b"), "edges")
    out = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "up")
        while True:  # pointer jumping: parents are smaller, so this ends at roots
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            moved = not jumped.filter("moved").isEmpty()
            forget(up)
            up = jumped
            if not moved:
                break
        out = up.select("node", F.col("up").alias("root")) if out is None else written(out.join(up.select(F.col("node").alias("root"), F.col("up").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        ends = up.select(F.col("node"), F.col("up"))
        rest = edges.join(ends.withColumnsRenamed({"node": "a", "up": "x"}), "a").join(ends.withColumnsRenamed({"node": "b", "up": "y"}), "b")
        rest = written(rest.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(edges)
        edges = rest
        if edges.isEmpty():
            return out


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, r: int = RADIUS, shard_rows: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links.

    Nulls: a null text is empty; a null doc_id never is the smallest unless its component has no other. Repeated rows
    stay repeated. Empty input: no rows. Other columns of docs are not read."""
    return _grouped(docs, doc_id, text, r, shard_rows).drop("group")


def _grouped(docs: DataFrame, doc_id: Column, text: Column, r: int = RADIUS, shard_rows: int = 20_000, **more: Column) -> DataFrame:
    """near_duplicates with the component itself (group), which tells apart components whose smallest ids are equal, and columns of one's own."""
    fps = written(docs.select(doc_id.alias("doc_id"), fingerprint(text).alias("fp"), *[c.alias(name) for name, c in more.items()]), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(link(distinct.select("fp"), distinct.count(), r, shard_rows))
    by_fp = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = by_fp.join(least, "root").select("fp", "component_id", F.col("root").alias("group"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id", "group", *more)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each near-duplicate group; a row with the smallest doc_id stays.

    A row with a null doc_id goes by a negative number made from its text; of repeated rows with one id one stays.
    Rows that share an id but not a group are kept apart: one stays for each group."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id"), -F.abs(F.shiftright(F.xxhash64(text), 1)) - 1)
    # chosen on ids and hashes; the texts are shuffled once, to meet the chosen ones
    slim = _grouped(docs, ident, F.col("text"), t=F.xxhash64("text"), h=F.xxhash64(row)).filter("doc_id = component_id")
    slim = slim.groupBy("doc_id", "group", "t", "h").agg(F.count("*").alias("n"))
    first = slim.groupBy("doc_id", "group").agg(F.min(F.struct("t", "h", "n")).alias("f")).select(F.col("doc_id").alias("ident"), "group", "f.t", "f.h", "f.n")
    first = written(first, "kept")
    rows = docs.select(row.alias("row"), ident.alias("ident"), F.xxhash64("text").alias("t"), F.xxhash64(row).alias("h")).join(first, ["ident", "t", "h"])
    if first.filter("n > 1").isEmpty():
        return rows.select("row.*")
    once = rows.filter("n > 1").groupBy("ident", "group").agg(F.first("row").alias("row"))  # equal rows
    return rows.filter("n = 1").select("row.*").unionByName(once.select("row.*"))
