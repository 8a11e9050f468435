"""Quality rules: counts, and the divergence of a text from what its language looks like.

Base counts: see `stats_of`. Method: the histogram of a text's character classes and that of its most common words (one
class for all other words) are compared with references of each language by Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1). The smallest distances over the languages count, so neither a wrong nor a missing
`lang` fails a clean text. Short texts differ from any reference by chance, by about 1 / sqrt(words); so a text fails if
a distance is over a + b / sqrt(words), with (a, b) of MOST_CLASS or MOST_WORDS, and texts under LEAST_WORDS words are
too short for the test and pass it.

References are counted exactly over all documents with a non-null lang, in two passes. The first counts the classes, and
each task reports the words of at least 1/REPORTED of a language's words since its last report (a report goes out whenever the task holds
KEPT words and languages, so memory doesn't grow with languages or texts), and how often any other word can have come. The sum of a
word's reports so is short by at most the sum of those; all words that could be among the COMMON most frequent by that are counted
exactly by the second pass (a language that left out no word needs none; over KNOWN such words are counted by a shuffle of all words instead
of a broadcast), and the COMMON most frequent of over 1/4500 stay, while each word besides counts in the class of all others.

Every language with a word has a reference, and every text is compared with all of them. References stay a table of the shared folder; the driver and
a worker hold those of LANGUAGES languages at a time, a broadcast each, and a text keeps its smallest distances over the broadcasts. So
memory doesn't grow with languages, but time does: a comparison for each document and language. MOST_LANGUAGES, None unless
a caller sets it, gives up whole results for that time: only so many languages with the most words have references then,
and documents of other languages pass the divergence test."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches, forget, written

SYMBOLS = "#*$%&|<>"
COMMON, KEPT, REPORTED, KNOWN, LANGUAGES = 64, 200_000, 20_000, 200_000, 2_000
MOST_LANGUAGES = None
COUNTS = "lang string, word string, n long"
MOST_CLASS, MOST_WORDS, LEAST_WORDS = (0.13, 0.9), (0.16, 2.6), 50
CLASSES = 7  # lower, upper, digit, white space, punctuation, other ASCII, beyond ASCII


def _class_table() -> np.ndarray:
    out = np.zeros((256, CLASSES), dtype=np.int64)
    for b in range(256):
        c = chr(b)
        k = 6 if b >= 0xC0 else None if b >= 0x80 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 5
        if k is not None:
            out[b, k] = 1
    return out


TABLE = _class_table()


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that the text has twice or more, the first included."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    key = codes[: len(codes) - size + 1]
    for k in range(1, size):
        key = key * len(number) + codes[k : len(codes) - size + 1 + k]
        if k + 1 < size and len(number) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    again = n[inverse] >= 2
    hit = np.zeros(len(codes), dtype=bool)
    for k in range(size):
        hit[k : len(again) + k] |= again
    return int(hit.sum())


def stats_of(text: str) -> tuple[dict, list[bytes], np.ndarray]:
    """Base counts of a text; its words (split at ASCII white space), and its character class counts."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    classes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ TABLE
    lines = [line for line in text.split("\n") if line.encode("utf-8", "replace").strip()]
    repeat = repeated_words(words)
    base = {
        "n_words": len(words),
        "word_chars": int(classes.sum() - classes[3]),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
    }
    base["base_failed"] = base["n_words"] < 50 or 100 * repeat > 50 * base["n_words"]
    return base, words, classes


def _reference(batches: Iterator[pa.RecordBatch], reported: float = REPORTED) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task: class counts as the words "0" to "6" with a leading space, all words as " n", the most that a word left out came as " short"."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def report() -> pa.RecordBatch:
        rows = []
        for lang, counts in classes.items():
            total = words[lang].total()
            rows += [(lang, f" {k}", int(n)) for k, n in enumerate(counts)] + [(lang, " n", total)]
            often = [(lang, w.decode("utf-8", "replace"), n) for w, n in words[lang].items() if n * reported >= total]
            rows += [*often, (lang, " short", int((total - 1) // reported) if len(often) < len(words[lang]) else 0)]
        words.clear()
        classes.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    for batch in batches:
        langs, at = batch.column(1).to_pylist(), 0
        for block in blocks(batch.column(0)):
            for text in block:
                lang, raw = langs[at], text.encode("utf-8", "replace")
                at += 1
                classes[lang] = classes.get(lang, 0) + np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ TABLE
                words.setdefault(lang, Counter()).update(raw.split())
            if len(words) + sum(map(len, words.values())) > KEPT:
                yield report()
    yield report()


def _exact(known: Broadcast):
    """(lang, word, n) of a task: how often each language's known words occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for block in blocks(batch.column(0)):
                for text in block:
                    lang = langs[at]
                    at += 1
                    if lang in known.value:
                        counts = Counter(text.encode("utf-8", "replace").split())
                        for w in counts.keys() & known.value[lang]:
                            found[lang, w] = found.get((lang, w), 0) + counts[w]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w.decode() for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    return run


def _languages(docs: DataFrame) -> Iterator[Row]:
    """(lang, total, classes, common: (n, word) of its common words) of each language with a word, a part of the table at a time on the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.filter("lang IS NOT NULL").select("text", "lang")
    summed = written(texts.mapInArrow(_reference, COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "quality-words")
    special = F.col("word").startswith(" ")
    amount = lambda name: F.coalesce(F.sum(F.when(F.col("word") == f" {name}", F.col("n"))), F.lit(0))
    langs = summed.filter(special).groupBy("lang").agg(amount("n").alias("total"), amount("short").alias("short"), F.array(*map(amount, range(CLASSES))).alias("classes")).filter("total > 0")
    if MOST_LANGUAGES:
        langs = langs.orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES)
    langs = written(langs, "quality-languages")
    n_langs = langs.count()
    small = F.broadcast if n_langs <= LANGUAGES else lambda rows: rows

    # a word among the COMMON by exact counts is reported at least as often as the last of the COMMON by reports, less what reports left out
    top = summed.filter(~special)
    if MOST_LANGUAGES:
        top = top.join(small(langs.select("lang")), "lang", "left_semi")
    salt = F.pmod(F.xxhash64("word"), F.lit(64))  # first within parts of a language, then among the few that are left
    best = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON).drop("rank")
    last = best(best(top, "lang", salt), "lang").groupBy("lang").agg(F.when(F.count("*") >= COMMON, F.min("n")).otherwise(0).alias("last"))
    least = langs.join(small(last), "lang", "left").select("lang", "total", "short", F.expr("greatest(coalesce(last, 0), total div 4500) - short AS least"))
    likely = written(top.join(small(least), "lang").filter("n >= least").select("lang", "word", "n", "total", "short"), "quality-likely")

    rough = likely.filter("short > 0").select("lang", "word")
    if rough.count() <= KNOWN:
        known: dict[str, set] = {}
        for r in rough.collect():
            known.setdefault(r.lang, set()).add(r.word.encode())
        counted = texts.mapInArrow(_exact(spark.sparkContext.broadcast(known)), COUNTS) if known else rough.withColumn("n", F.lit(0))
    else:
        counted = texts.mapInArrow(lambda batches: _reference(batches, inf), COUNTS).join(rough, ["lang", "word"])
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    exact = likely.filter("short = 0").select("lang", "word", "n").unionByName(counted)
    exact = exact.join(small(langs.select("lang", "total")), "lang").filter("n * 4500 > total")
    common = best(exact, "lang").groupBy("lang").agg(F.collect_list(F.struct("n", "word")).alias("common"))
    out = langs.join(small(common), "lang", "left").select("lang", "total", "classes", "common")
    out = written(out.repartition(-(-max(1, n_langs) // LANGUAGES), "lang"), "quality-references")
    for done in (summed, langs, likely):
        forget(done)
    yield from out.toLocalIterator()
    forget(out)


def _reference_of(rows: list[Row]) -> dict:
    classes = np.array([r.classes for r in rows], dtype=float).reshape(-1, CLASSES)
    words = []
    for r in rows:
        share = {w.encode(): n / max(1, r.total) for n, w in sorted(r.common or [], key=lambda c: (-c[0], c[1]))}
        words.append(share | {None: max(0.0, 1 - sum(share.values()))})
    return {"langs": [r.lang for r in rows], "classes": classes / np.maximum(1, classes.sum(axis=1, keepdims=True)), "words": words}


def references(docs: DataFrame) -> dict:
    """{"langs": names, "classes": languages x CLASSES, "words": one {word: share} a language, with None for all others}, all languages at once."""
    return _reference_of(sorted(_languages(docs), key=lambda r: r.lang))


def by_word(reference: dict) -> dict:
    """A reference with its words the other way: the languages that have a word, and its shares there, are lang[a:b] and share[a:b] of a, b = at[word]."""
    found: dict[bytes, list] = {}
    for k, share in enumerate(reference["words"]):
        for w, q in share.items():
            if w is not None:
                found.setdefault(w, []).append((k, q))
    ends = np.cumsum([0, *map(len, found.values())]).tolist()
    pairs = [pair for f in found.values() for pair in f]
    rest = np.array([share[None] for share in reference["words"]], dtype=float)
    lang, share = np.array([k for k, _ in pairs], dtype=np.int64), np.array([q for _, q in pairs], dtype=float)
    at = dict(zip(found, zip(ends, ends[1:], strict=False), strict=True))
    return {"classes": reference["classes"], "at": at, "lang": lang, "share": share, "rest": rest, "all": np.bincount(lang, share, len(rest))}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a class of shares p and q adds to twice the divergence, p + q if only one has it."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)


def divergences(counts: Counter, classes: np.ndarray, reference: dict) -> tuple[float, float]:
    """The smallest class distance and word distance of a text with words over the languages of a reference by_word."""
    by_class = float(distance(classes / max(1, classes.sum()), reference["classes"]).min())
    n, n_langs, at = counts.total(), len(reference["rest"]), reference["at"]
    spans = [(*at[w], counts[w]) for w in counts.keys() & at.keys()]
    twice, other = reference["all"], np.ones(n_langs)  # as if no language's word were in the text
    if spans:
        first, last, c = np.array(spans).T
        length = last - first
        k = np.repeat(last - np.cumsum(length), length) + np.arange(length.sum())
        lang, q, c = reference["lang"][k], reference["share"][k], np.repeat(c, length)
        twice = twice + np.bincount(lang, _apart(c / n, q) - q, n_langs)
        other = 1 - np.bincount(lang, c, n_langs) / n
    twice = twice + _apart(other, reference["rest"])
    return by_class, float(np.sqrt(np.clip(twice.min() / 2, 0, 1)))


FIELDS = "n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,class_distance:double,word_distance:double"
_KIND = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def diverges(n_words: int, by_class: float, by_words: float, most_class: tuple = MOST_CLASS, most_words: tuple = MOST_WORDS) -> bool:
    least = lambda bound: bound[0] + bound[1] / n_words**0.5
    return n_words >= LEAST_WORDS and (by_class > least(most_class) or by_words > least(most_words))


def rules(docs: DataFrame, most_class: tuple = MOST_CLASS, most_words: tuple = MOST_WORDS) -> DataFrame:
    """(doc_id, base counts, kept, class_distance, word_distance) for each row of docs (doc_id, text, lang; others aren't read).

    Null and empty texts have no words and fail the base; a corpus without any lang has no references, and then only the
    base decides. Repeated rows stay repeated."""
    shared, langs = [], []
    for rows in batched(_languages(docs), LANGUAGES):
        reference = _reference_of(rows)
        shared.append(docs.sparkSession.sparkContext.broadcast(by_word(reference)))
        if MOST_LANGUAGES:
            langs += reference["langs"]

    @F.arrow_udf(f"struct<{FIELDS}>")
    def judge(texts: pa.Array, other: pa.Array) -> pa.Array:
        rows, others = [], other.to_pylist()
        for block in blocks(texts):
            known, first = [], len(rows)
            for text in block:
                base, words, classes = stats_of(text)
                none = not words or not shared
                rows.append(base | {"class_distance": 0.0 if none else 1.0, "word_distance": 0.0 if none else 1.0})
                known.append((Counter(words), classes))
            for b in shared:
                reference = b.value
                if len(shared) > 1 and hasattr(b, "_path"):
                    del b._value  # a worker holds one at a time
                for row, (counts, classes) in zip(rows[first:], known, strict=True):
                    if counts:
                        c, w = divergences(counts, classes, reference)
                        row["class_distance"], row["word_distance"] = min(c, row["class_distance"]), min(w, row["word_distance"])
            for row, passes in zip(rows[first:], others[first : len(rows)], strict=True):
                bad = diverges(row["n_words"], row["class_distance"], row["word_distance"], most_class, most_words) and not passes
                row["kept"] = not (row["base_failed"] or bad)
        return pa.array(rows, type=pa.struct([(f.split(":")[0], _KIND[f.split(":")[1]]) for f in FIELDS.split(",")]))

    other = F.col("lang").isNotNull() & ~F.col("lang").isin(langs) if MOST_LANGUAGES and len(langs) >= MOST_LANGUAGES else F.lit(False)
    return docs.select("doc_id", judge("text", other).alias("r")).select("doc_id", "r.*")
