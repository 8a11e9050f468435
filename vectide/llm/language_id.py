"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, white space runs become one space, and its n-grams of 1 to 3 characters are hashed to 2**15
buckets with integer arithmetic in numpy. Fitting counts buckets by language (partition sums, then a shuffle of
bounded counts). The log-probability matrix, buckets x languages, is broadcast; it holds at most MATRIX numbers, so from 1,025
languages on neighbouring buckets are joined. A block of texts is one sparse matrix, rows of bucket numbers and where each
text's rows start; its product with the matrix is taken in numpy, in parts of bounded size. The fit takes all
labelled rows up to `fit_rows`, above that about so many, chosen by hash (documented bound of a classifier's fit)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches, bounded_sample

ORDERS, BITS, FIT_ROWS, MATRIX, SMOOTHING = (1, 2, 3), 15, 40_000, 1 << 25, 0.5
_MUL = np.uint32(2654435761)


def buckets(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, starts, bucket numbers) of the n-grams of runs of texts; long runs come in parts of about `most` characters."""
    space = str.split
    for at, text in enumerate(texts):
        text = f" {' '.join(space(text.lower()))} "
        for part in range(0, max(1, len(text) - 2), most):
            codes = np.frombuffer(text[part : part + most + 2].encode("utf-32-le", "replace"), dtype="<u4")
            last = part + most >= len(text) - 2
            found, h = [], np.zeros(len(codes), dtype=np.uint32)
            for n in range(1, ORDERS[-1] + 1):
                h = (h[: len(codes) - n + 1] * np.uint32(31) + codes[n - 1 :]) * _MUL if len(codes) >= n else h[:0]
                if n in ORDERS:
                    keep = h if last else h[:most]
                    found.append((keep ^ np.uint32(n * 40503)) * _MUL >> np.uint32(32 - BITS))
            yield at, np.concatenate(found).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        langs, at = batch.column(1).to_pylist(), 0
        for block in blocks(batch.column(0)):
            for i, found in buckets(block):
                lang = langs[at + i]
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, dtype=np.int64)
                sums[lang] += np.bincount(found, minlength=1 << BITS)
            for lang in langs[at : at + len(block)]:
                rows[lang] = rows.get(lang, 0) + 1
            at += len(block)
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.r_[used, -1]), pa.array(np.r_[counts[used], rows[lang]])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, matrix: int = MATRIX) -> dict:
    """{"langs": sorted names, "logp": float32 matrix buckets x languages, "prior": log shares, "join": bits that buckets lost}.

    From (text, lang, and doc_id where there is one, which tells copies of a text apart); null langs are left out, null texts are empty."""
    bounded_batches(labelled.sparkSession)
    ids = ["doc_id"] if "doc_id" in labelled.columns else []
    rows = bounded_sample(labelled.filter("lang IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("text"), "lang", *ids), fit_rows, 5, copies=True).select("text", "lang")
    n_langs, join = rows.select("lang").distinct().count(), 0
    while (n_langs << (BITS - join)) > matrix and join < BITS:
        join += 1
    found = rows.mapInArrow(_counts, "lang string, bucket long, n long")
    got = found.groupBy("lang", F.shiftright("bucket", join).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # bucket -1 counts rows
    langs = sorted(set(got["lang"].to_pylist()))
    counts, docs = np.zeros((1 << (BITS - join), len(langs))), np.ones(len(langs))
    if langs:
        at = np.searchsorted(np.array(langs, dtype=object), np.array(got["lang"].to_pylist(), dtype=object))
        bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
        gram = bucket >= 0
        counts[bucket[gram], at[gram]] = n[gram]
        docs[at[~gram]] = n[~gram]
    logp = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=0))
    return {"langs": langs, "logp": logp.astype(np.float32), "prior": np.log(docs / docs.sum()) if langs else docs, "join": join}


def scores(texts: list[str], model: dict, most: int = 1 << 20) -> np.ndarray:
    """texts x languages: log probabilities. The rows of logp that the n-grams name are summed by text, about `most` numbers at a time."""
    logp, z = model["logp"], np.tile(model["prior"].astype(float), (len(texts), 1))
    part, owner, n = [], [], 0

    def add():
        rows, starts = np.concatenate(part) >> model["join"], np.cumsum([0, *map(len, part[:-1])])
        for a in range(0, len(rows), step := max(1, most // logp.shape[1])):
            b = min(len(rows), a + step)
            first = np.searchsorted(starts, a, "right") - 1
            cuts = np.r_[a, starts[(starts > a) & (starts < b)]]
            np.add.at(z, np.array(owner)[first : first + len(cuts)], np.add.reduceat(logp[rows[a:b]], cuts - a, axis=0, dtype=np.float64))

    for i, found in buckets(texts):
        if len(found):
            part.append(found)
            owner.append(i)
            n += len(found)
        if n > most:
            add()
            part, owner, n = [], [], 0
    if part:
        add()
    return z


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs; `und` and 0 if the text is null or has no letter, or nothing was learned.

    score: the posterior probability of lang_pred. Repeated rows stay repeated; other columns aren't read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def classify(texts: pa.Array) -> pa.Array:
        langs, out, likely = shared.value["langs"], [], []
        for block in blocks(texts):
            z = scores(block, shared.value)
            out += [langs[k] for k in z.argmax(axis=1)]
            likely.append(1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(np.concatenate(likely) if likely else [], pa.float64())], names=["lang", "score"])

    if not model["langs"]:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", lettered.alias("lettered"), classify("text").alias("r"))
    return rows.select("doc_id", F.when(F.col("lettered"), F.col("r.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("r.score")).otherwise(0.0).alias("score"))
