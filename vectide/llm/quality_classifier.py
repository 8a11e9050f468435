"""A quality classifier from weak labels.

Eight heuristic labellers each vote good (1), bad (0) or abstain (2) on every document. Their votes are counted by
pattern (at most 3**8 rows, whatever the input), and expectation-maximisation over the counts estimates each
labeller's vote probabilities in good and bad documents and the share of good ones, without any true label.
The posterior of each document's pattern is its soft label; a linear scorer over hashed words and word shapes learns it
by logistic regression on a bounded sample (`fit_rows` different rows and `fit_entries` words in all, documented
parameters; chosen by hash, so alike for any layout), and scores all documents."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vectide.llm.common import blocks, bounded_batches, bounded_sample, forget, written
from vectide.llm.quality_rules import stats_of

FIT_ROWS, FIT_ENTRIES, BITS, ROUNDS, PRIOR = 8_000, 4_000_000, 14, 150, 0.5
GOOD, BAD, ABSTAIN = 1, 0, 2
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)))

#: Bytes that words of prose end in.
_ENDS = frozenset(b for b in range(256) if chr(b).isalnum() or b >= 0x80 or chr(b) in ".,;:?)\"'")


def _vote(x: float, good: float, bad: float) -> int:
    """good and bad are bounds: x at most good (or at least, if good > bad) votes good, beyond bad votes bad."""
    up = good > bad
    return GOOD if (x >= good if up else x <= good) else BAD if (x <= bad if up else x >= bad) else ABSTAIN


def votes_of(text: str) -> list[int]:
    base, words, classes = stats_of(text)
    n, chars = len(words), max(1, base["word_chars"])
    if n < 5:
        return [ABSTAIN] * 8
    lines = max(1, text.count("\n") + 1)
    ends = sum(w[-1] in _ENDS for w in words) / n
    return [
        _vote(base["n_symbols"] / chars, 0.005, 0.03),
        _vote(classes[1] / max(1, classes[0] + classes[1] + classes[6]), 0.15, 0.4),
        _vote(base["n_repeat_words"] / n, 0.15, 0.4),
        _vote(base["n_dup_lines"] / lines, 0.1, 0.4) if lines >= 3 else ABSTAIN,
        _vote(len(set(words)) / n, 0.35, 0.2) if n >= 30 else ABSTAIN,
        _vote(ends, 0.85, 0.7),
        _vote(sum(w in (b"|", b"-", b"*", b">") for w in words) / n, 0.02, 0.15),
        _vote(sum(w.endswith(b"!") for w in words) / n, 0.05, 0.3),
    ]


@F.arrow_udf(StringType())
def _votes(texts: pa.Array) -> pa.Array:
    return pa.array(["".join(map(str, votes_of(t))) for b in blocks(texts) for t in b], type=pa.string())


def estimate(patterns: list[tuple[str, int]], rounds: int = 200, prior: float = PRIOR) -> dict:
    """{"share": of good documents, "bad": [class, labeller] probability of a bad vote, "posterior": {pattern: P(good)}}.

    Abstentions are taken as missing votes. The labellers are made to call few good documents bad; that is the Beta
    prior of `prior` times the votes, which also keeps the two classes from changing places."""
    start = np.array([[0.25], [0.002]])
    if not patterns:
        return {"share": 0.5, "bad": np.repeat(start, 8, axis=1), "posterior": {}}
    votes = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    is_bad, voted = (votes == BAD).astype(float), (votes != ABSTAIN).astype(float)
    bad, share = np.repeat(start, votes.shape[1], axis=1), 0.85
    for _ in range(rounds):
        z = is_bad @ np.log(bad).T + (voted - is_bad) @ np.log(1 - bad).T + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
        last, share = share, float(np.clip((n * good).sum() / n.sum(), 0.05, 0.95))
        for c, w in enumerate((n * (1 - good), n * good)):
            weight = prior * (w[:, None] * voted).sum(axis=0) + 1
            bad[c] = np.clip(((w[:, None] * is_bad).sum(axis=0) + weight * start[c]) / ((w[:, None] * voted).sum(axis=0) + weight), 1e-4, 1 - 1e-4)
        if abs(share - last) < 1e-9:
            break
    return {"share": share, "bad": bad, "posterior": {pattern: float(g) for (pattern, _), g in zip(patterns, good, strict=True)}}


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's words, word shapes (classes of the first two and last three characters) and how often words and lines repeat."""
    words = text.encode("utf-8", "replace").split()
    counts = Counter(words)
    shapes: Counter = Counter()
    for w, n in counts.items():
        s = w.translate(_SHAPE)
        shapes[s[:2] + b"\0" + s[-3:]] += n
    n, size = max(1, len(words)), min(9, len(words).bit_length())
    lines = text.split("\n")
    marks = [b"\1%d:%d" % (size, 10 * len(counts) // n), b"\2%d:%d" % (size, 10 * max(counts.values(), default=0) // n), b"\3%d" % (10 * len(set(lines)) // len(lines)), b"\4%d" % size]
    digest, mask = xxhash.xxh64_intdigest, (1 << BITS) - 1
    at = np.fromiter(chain((digest(w.lower(), 3) & mask for w in counts), (digest(s, 4) & mask for s in shapes)), dtype=np.int64, count=len(counts) + len(shapes))
    x = np.sqrt(np.fromiter(chain(counts.values(), shapes.values()), dtype=float, count=len(at)) / n)
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    return np.append(at, [digest(m, 5) & mask for m in marks]), np.append(x, [0.5] * len(marks))


def learn(at: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights and, last, the constant: logistic regression on soft labels y by Adagrad over all rows; entries are (row, bucket, value)."""
    w = np.zeros((1 << BITS) + 1)
    if not len(y):
        return w
    weight = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).mean()), 0.5 / max(1e-9, (y < 0.5).mean())) / len(y)
    seen = np.full(len(w), 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights=x * w[at], minlength=len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(at, weights=x * e[row], minlength=1 << BITS), e.sum()) + 1e-6 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES) -> dict:
    """Model from docs (doc_id, text); labels are neither needed nor read. Null texts are empty and abstain everywhere."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    patterns = sorted((r.v, r.n) for r in docs.select(_votes(text).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect())
    model = estimate(patterns)

    @F.arrow_udf("struct<v:string,at:array<int>,x:array<float>>")
    def sample(texts: pa.Array) -> pa.Array:
        out = []
        for t in (t for b in blocks(texts) for t in b):
            at, x = hashed(t)
            sums = np.bincount(at, weights=x, minlength=1 << BITS)  # an entry a bucket, however many words
            out.append({"v": "".join(map(str, votes_of(t))), "at": (used := np.flatnonzero(sums)), "x": sums[used]})
        return pa.array(out, type=pa.struct([("v", pa.string()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    rows = bounded_sample(docs.select("doc_id", text.alias("text")), fit_rows, 13)
    rows = written(rows.select(F.xxhash64("doc_id", "text").alias("place"), sample("text").alias("s")).select("place", "s.*"), "scorer-rows")
    entries = rows.agg(F.sum(F.size("at"))).first()[0] or 0
    few = rows.filter(F.pmod(F.xxhash64(F.lit(17), "place"), F.lit(1 << 30)) < int((1 << 30) * fit_entries / entries)) if entries > fit_entries else rows
    got = few.orderBy("place").toArrow().combine_chunks()  # in one order, so that reruns agree
    forget(rows)
    y = np.array([model["posterior"].get(v, model["share"]) for v in got["v"].to_pylist()])
    at, x = (got[c].combine_chunks() for c in ("at", "x"))
    row = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(y) else np.zeros(0, np.int64)
    weights = learn(at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False).astype(float), row, y)
    return model | {"weights": weights.astype(np.float32)}


def scorer(model: dict, spark):
    """Column -> Column: how good a text is, 0 to 1."""
    shared = spark.sparkContext.broadcast(model["weights"])

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for t in (t for b in blocks(texts) for t in b):
            at, x = hashed(t)
            out.append(float(x @ w[at] + w[-1]))
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30))), type=pa.float64())

    def of(text: Column) -> Column:
        return score(text)

    return of


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, predicted, kept) for each row of docs (doc_id, text; other columns aren't read): predicted 1 and kept if score >= 0.5.

    A null text is empty and gets the constant's score; repeated rows stay repeated; an empty table gives no rows."""
    model = fit(docs, fit_rows)
    rows = docs.select("doc_id", scorer(model, docs.sparkSession)(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
