"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are normalised alike: A-Z lower-cased, words are runs of letters, digits and non-ASCII characters.
The automaton is built over the items' word numbers and accepts every run of words inside an item. Streaming a
document keeps, for each word, the longest run ending there that some item contains. Where that length reaches the
window (10 words), or a whole item that is shorter, the words are hit; the automaton's state says which items.

Before streaming, numpy cuts a document to the stretches in which each pair of neighbours is a pair of neighbours in
some item (single words, if an item has only one): outside them the longest match is under two words.

The items are cut in blocks of at most `block_words` words, one automaton each. A worker holds the automata of at most
`pass_words` words (about 0.6 KB a word); items beyond that take further passes over the documents, each of which adds
its spans to those found before. So memory is bounded whatever the test suite's size."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches, forget, written

WINDOW, BLOCK_WORDS, PASS_WORDS = 10, 200_000, 1_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # over lower-cased UTF-8: every byte of a non-ASCII character is over 0x7F


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class Automaton:
    """Generalised suffix automaton of a block of items [(item id, words)], with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        pairs = set()
        for _, codes in coded:
            pairs.update(zip(codes, codes[1:], strict=False))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), dtype=np.int64)
        #: state -> items, for the states that stand for a window; state -> (length, items) for whole short items
        self.windows, self.short = defaultdict(set), {}
        for item, codes in coded:
            state = matched = 0
            for c in codes:
                state, matched = self.next[state][c], matched + 1
                while self.length[self.link[state]] >= window if state else False:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if matched >= window:
                    self.windows[state].add(item)
            if len(codes) < window:
                at = 0
                for c in codes:
                    at = self.next[at][c]
                self.short.setdefault(at, (len(codes), set()))[1].add(item)
        #: nearest state on the suffix links, itself included, that stands for a whole short item
        self.out = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.out[s] = s if s in self.short else self.out[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        length, link, step = self.length, self.link, self.next

        def split(p: int, q: int) -> int:
            clone = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            step.append(dict(step[q]))
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        if c in step[last]:  # generalised: this run of words is known from an earlier item
            q = step[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        state, p = len(length), last
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[state] = q if length[q] == length[p] + 1 else split(p, q)
        return state

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, word numbers) of the parts of a document that can hold a match of the shortest window."""
        codes = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        if self.shortest < 2:
            good, least = codes >= 0, 1
        else:
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            good, least = (codes[:-1] >= 0) & (codes[1:] >= 0) & (self.pairs[at] == pair), self.shortest - 1
        edge = np.flatnonzero(np.diff(np.r_[0, good.view(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= least:
                yield int(a), codes[a : b + (self.shortest >= 2)].tolist()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end) of word positions, in order and apart, and the items with an occurring window."""
        spans, items = [], set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, items
        step, link, length, window = self.next, self.link, self.length, self.window
        for start, codes in self.stretches(words):
            state = matched = 0
            for i, c in enumerate(codes, start + 1):
                while state and c not in step[state]:
                    state = link[state]
                    matched = length[state]
                if c in step[state]:
                    state, matched = step[state][c], matched + 1
                long = 0
                if matched >= window:
                    at = state
                    while length[link[at]] >= window:
                        at = link[at]
                    items |= self.windows[at]
                    long = window
                at = self.out[state]
                while at > 0:
                    n, own = self.short[at]
                    if n <= matched:
                        items |= own
                        long = max(long, n)
                    at = self.out[link[at]]
                if long:
                    while spans and spans[-1][1] >= i - long:
                        long = max(long, i - spans.pop()[0])
                    spans.append((i - long, i))
        return spans, items


def automata(bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> list[tuple[str, int, list[Broadcast]]]:
    """For each pass a name, the window, and the broadcasts of its blocks of (item_id, words); a longer item than a block is one block."""
    sc, out, block, n, size = bench.sparkSession.sparkContext, [], [], 0, 0

    def put():
        nonlocal size
        if block:
            if not out or size + n > pass_words:
                out.append((uuid.uuid4().hex, window, []))
                size = 0
            out[-1][2].append(sc.broadcast(block))
            size += n

    for row in bench.select("item_id", "text").toLocalIterator():  # one partition of the items at a time
        words = words_of(row.text)
        if block and n + len(words) > block_words:
            put()
            block, n = [], 0
        block.append((row.item_id, words))
        n += len(words)
    put()
    return out or [(uuid.uuid4().hex, window, [])]


_BUILT: dict = {}  # of a worker: the automata of the last operator it ran


def _built(sources: tuple) -> list[Automaton]:
    key, window, parts = sources
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Automaton(b.value, window) for b in parts]
    return _BUILT[key]


def scan_words(parts: list[Automaton], words: list[bytes]) -> tuple[np.ndarray, list[str]]:
    hit, items = np.zeros(len(words), dtype=bool), set()
    for a in parts:
        spans, found = a.scan(words)
        items |= found
        for s, e in spans:
            hit[s:e] = True
    return hit, sorted(str(i) for i in items if i is not None)


_SPANS, _FOUND = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), "struct<n_words:long,spans:array<struct<s:int,e:int>>,items:array<string>>"


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0])).tolist()
    return [{"s": a, "e": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _scanned(docs: DataFrame, passes: list[tuple], *keep: str) -> DataFrame:
    """The columns `keep` and found (n_words, spans of hit word positions, items) of docs (text, ...); a table for each pass but the last."""

    def scan_by(sources: tuple):
        @F.arrow_udf(_FOUND)
        def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            parts = _built(sources)
            for texts, before in batches:
                rows, earlier = [], before.to_pylist()
                for block in blocks(texts):
                    for text in block:
                        words = words_of(text)
                        hit, items = scan_words(parts, words)
                        if known := earlier[len(rows)]:
                            for r in known["spans"]:
                                hit[r["s"] : r["e"]] = True
                            items = sorted({*items, *known["items"]})
                        rows.append({"n_words": len(words), "spans": _runs(hit), "items": items})
                yield pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]))

        return scan

    rows, last = docs.withColumn("found", F.lit(None).cast(_FOUND)), None
    for i, sources in enumerate(passes):
        rows = rows.select(*dict.fromkeys([*keep, "text"]), scan_by(sources)("text", "found").alias("found"))
        if i + 1 < len(passes):
            rows = written(rows, "spans")
            if last is not None:
                forget(last)
            last = rows
    return rows.select(*keep, "found")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs; items: sorted ids, as strings, with an occurring window.

    An item whose id is null hits words like any other, and is not listed.
    Null and empty texts have no words, in documents and items. Repeated rows stay repeated; items with equal texts all
    count. An empty benchmark hits nothing. Other columns aren't read."""
    bounded_batches(docs.sparkSession)
    found = _scanned(docs.select("doc_id", "text"), automata(bench, window, block_words, pass_words), "doc_id")
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return found.select("doc_id", "found.n_words", n_hit.alias("n_hit"), "found.items")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def without(text: str, hit: np.ndarray, most_coverage: float) -> str | None:
    """text without its hit words and what is between them; None if they are more than most_coverage of its words."""
    if not hit.any():
        return text
    if hit.mean() > most_coverage:
        return None
    raw = text.encode("utf-8", "replace")
    found, out, last = list(WORD.finditer(raw.lower())), [], 0
    for r in _runs(hit):
        out.append(raw[last : found[r["s"]].start()])
        last = found[r["e"] - 1].end()
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, most_coverage: float = 0.8, pass_words: int = PASS_WORDS) -> DataFrame:
    """docs, in their columns, without hit spans; documents of which more than most_coverage is hit go.

    Removing a span can join words into a new window; the rest is scanned again until nothing is hit. A null text stays null."""
    bounded_batches(docs.sparkSession)
    passes = automata(bench, window, block_words, pass_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    if len(passes) == 1:
        sources = passes[0]

        @F.arrow_udf("string")
        def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            parts = _built(sources)
            for texts in batches:
                out = []
                for block in blocks(texts):
                    for text in block:
                        while (hit := scan_words(parts, words_of(text))[0]).any() and (rest := without(text, hit, most_coverage)) is not None:
                            text = rest
                        out.append(None if hit.any() else text)
                yield pa.array(out, type=pa.string())

        rows = rows.select("row", clean("text").alias("rest")).filter("rest IS NOT NULL")
    else:

        @F.arrow_udf("string")
        def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
            out, spans = [], found.field("spans").to_pylist()
            for block in blocks(texts):
                for text in block:
                    hit = np.zeros(len(words_of(text)), dtype=bool)
                    for r in spans[len(out)]:
                        hit[r["s"] : r["e"]] = True
                    out.append(without(text, hit, most_coverage))
            return pa.array(out, type=pa.string())

        while True:
            turn = written(_scanned(rows, passes, "row", "text").select("row", "text", cut("text", "found").alias("rest")).filter("rest IS NOT NULL"), "cut")
            if turn.filter("rest <> text").isEmpty():
                rows = turn.select("row", "rest")
                break
            rows = turn.select("row", F.col("rest").alias("text"))
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("rest"))
    out = {"text": text} | ({"n_chars": F.when(F.col("rest") == F.coalesce("row.text", F.lit("")), F.col("row.n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
