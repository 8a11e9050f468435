"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: each source has a weight and a most number of words (epochs x its size). The share of the total is dealt by
weight; sources above their cap are clamped and the excess goes to the others by weight, until none is above. That
fixed point is found in closed form: with sources in order of cap / weight, the clamped ones are a prefix. Ranks and
running sums over sources go by key ranges and one row a range, so sources may be as many as web domains.

Repetitions: a source takes each document floor(target / size) times whole, and the rest from documents in the order of
a seeded hash of id and text until the words suffice. The document at the cut is taken for a fraction of its words, so a source's
words meet its target to within rounding, even if a few documents hold most of its words; of rows equal in both, each is. The cut is found from sums over 4,096
hash ranges a source and then inside one range, so no source is sorted as a whole, however hot it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import forget, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def running(rows: DataFrame, order: list, **sums: Column) -> DataFrame:
    """rows with, for each of `sums`, its sum over all rows before in `order` (which must be total).

    Rows are cut into ranges; a table of one row a range gives the sums before it, and windows run inside a range."""
    tmp = written(rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "sorted")
    within, whole = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = tmp.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = by_range.select("_range", *[F.coalesce(F.sum(f"_{n}").over(whole), F.lit(0)).alias(f"_{n}_before") for n in sums])  # one row a task
    out = tmp.join(F.broadcast(before), "_range").withColumns({n: F.col(f"_{n}_before") + F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in sums})
    return out.select(*rows.columns, *sums)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    by_name = F.col("source").asc_nulls_last()
    s = running(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), [by_name], nth=F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(epochs)).alias("cap"))
    s = written(s.withColumn("ratio", F.col("cap") / F.col("w")), "weights")
    sums = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, weight = float(sums["size"] or 0) * float(share), float(sums.w or 0.0)
    # words still to deal and weight still to serve when the sources with a smaller ratio are clamped
    r = running(s, [F.col("ratio"), by_name], capped=F.col("cap"), served=F.col("w"))
    r = r.select("ratio", F.col("source").isNull().alias("last"), "source", ((F.lit(total) - F.col("capped")) / (F.lit(weight) - F.col("served"))).alias("level"))
    first = r.filter("level < ratio").agg(F.min(F.struct("ratio", "last", "source", "level")).alias("m")).first().m
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.col("w") * F.lit(float(first.level)))
    return s.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, whole, cut, num, den) from (source, size, key): whole repetitions, and which documents come once more.

    Documents with a key below cut come whole, those at cut for num / den of their words, the others not."""
    ranges = written(slim.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("size").alias("words")), "ranges")
    t = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    words, size = F.round(F.col("target")).cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    t = t.withColumn("rest", words % size).withColumn("whole", ((words - F.col("rest")) / size).cast("long"))
    t = written(t, "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r = ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    at = r.join(t.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).filter("before <= rest and rest < before + words").select("source", "range", "before", "rest")
    keys = slim.join(at.withColumnsRenamed({"source": "s", "range": "g"}), F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, 3) == F.col("g")))
    keys = keys.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("den"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("num", F.col("rest") - F.col("before") - F.coalesce(F.sum("den").over(upto), F.lit(0))).filter("num >= 0 and num < den").select(F.col("source").alias("s"), F.col("key").alias("cut"), "num", "den")
    return written(t.join(keys, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "num", "den"), "mix-plan")


def _extra(key: Column, size: Column) -> Column:
    """Words taken beyond the whole repetitions. No cut: nothing is left to take."""
    return F.when(key < F.col("cut"), size).when(key == F.col("cut"), F.floor(size * F.col("num") / F.col("den"))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source; other columns aren't read).

    A null text has no words; a null source is a source of its own, last in order; a null id is an empty one; rows with
    equal id and text share one key, and are taken in equal fractions if the cut is there. A source without words has
    target 0. Empty input: no rows."""
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), how.pop("seed", SEED)).alias("key")), "sizes")
    p = plan(slim, **how).withColumnRenamed("source", "s")
    rows = slim.join(F.broadcast(p) if p.count() <= 10_000 else p, F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("whole") * F.col("size") + _extra(F.col("key"), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole repetition; a fraction of a document is its first words up to that many."""
    seed = how.pop("seed", SEED)
    key, size = order_key(F.col("row.doc_id"), F.col("row.text"), seed), n_words(F.col("row.text"))
    slim = written(docs.select("source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key")), "sizes")
    p = plan(slim, **how).withColumnRenamed("source", "s")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(F.broadcast(p) if p.count() <= 10_000 else p, F.col("row.source").eqNullSafe(F.col("s")))
    part = F.when(key == F.col("cut"), _extra(key, size)).otherwise(F.lit(0))
    whole = F.col("whole") + F.when(key < F.col("cut"), 1).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = rows.select("row", F.explode(copies).alias("words"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(cut)
    n_chars = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None
    out = {"text": text} | ({"n_chars": n_chars.cast(dict(docs.dtypes)["n_chars"])} if n_chars is not None else {})
    return rows.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
