"""Toxicity by a weighted finite-state pattern grammar.

Clauses (text between . ! ? ; line ends and quotation marks) are strings of word classes. Five weighted transducers
rewrite them, each reading what the one before wrote, letter by letter:

  insult    an insult becomes a match of its arc's weight, 1.25 times that right after another insult
  threat    a harm verb alone writes nothing; a verb and somebody it is aimed at, on either side of it and at most REACH
            words apart, become a match: full weight after a speaker (I will kill you), half without one (kill you)
  target    a match that names or meets somebody addressed becomes a targeted one, 1.25 times (you wretch; wretch, you)
  negation  0.25 times a match within SCOPE words after a negation
  reported  0.5 times a match after a verb of reported speech

`compose` joins two transducers into one over pairs of states, reachable ones only, by feeding the first one's output to
the second; the grammar is the composition of all five, one table state x letter -> (state, output, weight). A document's
features are sums and counts over its matched clauses, not of isolated words, and a logistic model over them gives the score.

Learned from labelled rows (never from held-out ones): the words of the insult class, those far more frequent in toxic
documents, with their log odds as arc weights, and the logistic model. All words in LEAST_DOCUMENTS or more toxic documents are
ranked; those of at least LEAST_ODDS log odds are insults, the LEXICON best if they are more, so that the model has a fixed
size. The fit takes a bounded sample: all rows if there are up to `fit_rows`, else about so many, chosen by hash. The
words of the other classes are fixed lists."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches, bounded_sample, forget, written

FIT_ROWS, LEXICON, LEAST_DOCUMENTS, LEAST_ODDS = 50_000, 20_000, 3, 2.5
REACH, SCOPE = 3, 5
#: Letters that words are read as; then those that only transducers write.
OTHER, INSULT, HARM, SPEAKER, INTENT, TARGET, NEGATION, REPORTED = range(8)
AFTER, INSULTED, THREAT, FULL_THREAT, TARGETED, TARGETED_THREAT = range(8, 14)
LETTERS, MATCHES = 8, (INSULTED, THREAT, FULL_THREAT, TARGETED, TARGETED_THREAT)
WORDS = {
    HARM: "kill hurt destroy burn shoot stab punch beat strangle töten verletzen schlagen erschießen tuer frapper blesser matar golpear herir",
    SPEAKER: "i we ich wir je nous yo nosotros",
    INTENT: "will ll shall gonna going must should werde werden will wirst vais allons vas voy vamos va",
    TARGET: "you your yours yourself he she they him her them people du dich dein euch sie tu toi vous ton vosotros tú te usted ellos",
    NEGATION: "not no never neither nor without isn wasn aren don didn won nicht kein keine nie ne pas jamais sans nunca jamás sin",
    REPORTED: "said says told claimed wrote quoted reported according sagte sagt schrieb dit déclare écrit dijo dice escribió",
}
FIXED = {w: (c, 1.0) for c, words in WORDS.items() for w in words.split()}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")
ENDS = frozenset('.!?;\n"“”«»')


@dataclass(frozen=True)
class Transducer:
    """Letter to letter, deterministic: step(state, letter) is (next state, written letter, weight)."""

    start: Hashable
    step: Callable[[Hashable, int], tuple[Hashable, int, float]]

    def run(self, letters: list[int]) -> list[tuple[int, float]]:
        state, out = self.start, []
        for x in letters:
            state, y, w = self.step(state, x)
            out.append((y, w))
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What second does with the output of first; weights multiply."""

    def step(state, x):
        a, y, v = first.step(state[0], x)
        b, z, w = second.step(state[1], y)
        return (a, b), z, v * w

    return Transducer((first.start, second.start), step)


def _insult(last: int, x: int):
    return int(x == INSULT), INSULTED if x == INSULT else x, 1.25 if x == INSULT and last else 1.0


def _threat(state: tuple, x: int):
    """State: how far a speaker's intent goes (0, speaker, speaker with intent), words since a harm verb and since a target (0: none near)."""
    who, verb, aim = state
    verb, aim = (k and (k + 1) % (REACH + 2) for k in (verb, aim))
    if x in (SPEAKER, INTENT):
        who = 1 if x == SPEAKER else 2 * bool(who)
    said = FULL_THREAT if who else THREAT
    if x == TARGET:
        return ((who, 0, 0), said, 1.0 if who else 0.5) if verb else ((who, 0, 1), x, 1.0)
    if x == HARM:
        # somebody named before the verb is its target only if a speaker with intent follows (you I will kill)
        return ((0, 0, 0), said, 1.0) if aim and who == 2 else ((who, 1, 0), OTHER, 1.0)
    return (who, verb, aim), x, 1.0


def _target(state: tuple, x: int):
    """State: somebody was addressed in the clause; words since an insult nobody was addressed by (0: none near)."""
    seen, insult = state
    insult = insult and (insult + 1) % (REACH + 2)
    if x in (THREAT, FULL_THREAT):
        return (1, 0), TARGETED_THREAT, 1.25
    if x == INSULTED:
        return ((1, 0), TARGETED, 1.25) if seen else ((0, 1), x, 1.0)
    if x == TARGET:
        return (1, 0), AFTER if insult else x, 1.0  # AFTER: the insult before is targeted
    return (seen, insult), x, 1.0


def _negation(left: int, x: int):
    if x == NEGATION:
        return SCOPE, x, 1.0
    return max(0, left - 1), x, 0.25 if left and x in (*MATCHES, AFTER) else 1.0


def _reported(seen: int, x: int):
    return int(seen or x == REPORTED), x, 0.5 if seen and x in (*MATCHES, AFTER) else 1.0


PARTS = [Transducer(0, _insult), Transducer((0, 0, 0), _threat), Transducer((0, 0), _target), Transducer(0, _negation), Transducer(0, _reported)]


@cache
def grammar() -> list[list[tuple[int, int, float]]]:
    """The composition of all parts as a table [state][letter] -> (state, output, weight); state 0 starts."""
    whole = reduce(compose, PARTS)
    number, table = {whole.start: 0}, []
    for state in (todo := [whole.start]):
        row = []
        for x in range(LETTERS):
            to, y, w = whole.step(state, x)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], y, w))
        table.append(row)
    return table


N_FEATURES = 7


def features(text: str, lexicon: dict[str, tuple[int, float]]) -> list[float]:
    """Of the matched clauses: weight of insults, of threats, matches, clauses, largest clause, weight a 100 words, targeted weight."""
    insult = threat = largest = targeted = 0.0
    matches = clauses = 0
    tokens = TOKEN.findall(text.lower())
    arcs = list(map(lexicon.get, tokens))
    hits = [i for i, a in enumerate(arcs) if a and a[0] in (INSULT, HARM)]
    if not hits:
        return [0.0] * N_FEATURES
    table, done = grammar(), -1
    for hit in hits:
        if hit <= done:
            continue
        at = hit
        while at > done + 1 and tokens[at - 1] not in ENDS:
            at -= 1
        state, clause, last, before = 0, 0.0, 0.0, matches
        while at < len(tokens) and tokens[at] not in ENDS:
            letter, weight = arcs[at] or (OTHER, 1.0)
            state, out, scale = table[state][letter]
            if out in MATCHES:
                matches += 1
                value = weight * scale
                clause += value
                if out in (INSULTED, TARGETED):
                    insult += value
                    last = value
                else:
                    threat += value
                if out in (TARGETED, TARGETED_THREAT):
                    targeted += value
            elif out == AFTER:
                extra = 0.25 * last * scale
                clause, insult, targeted = clause + extra, insult + extra, targeted + last + extra
            at += 1
        clauses += matches > before
        largest = max(largest, clause)
        done = at
    return [insult, threat, float(matches), float(clauses), largest, 100 * (insult + threat) / max(1, len(tokens)), targeted]


def scaled(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


def logistic(x: np.ndarray, pos: np.ndarray, n: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps, from feature rows that occur n times, pos of them toxic."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (pos - n * p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return w


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task: documents with the word; the word "" counts documents."""
    found: dict[str, int] = {"": 0}
    for batch in batches:
        for block in blocks(batch.column(0)):
            for text in block:
                for w in set(TOKEN.findall(text.lower())):
                    found[w] = found.get(w, 0) + 1
            found[""] += len(block)
    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def sampled(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About fit_rows of the labels (doc_id, toxic), one an id."""
    return bounded_sample(labels, fit_rows, 7)


def fit(labelled: DataFrame) -> dict:
    """The model from (text, toxic), a bounded sample (see `sampled`).

    Null texts are empty; rows with a null label are left out; repeated rows count each time. Without toxic rows, or on an empty
    table, every score is the base rate."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.filter("toxic IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))

    def counts(toxic: int) -> DataFrame:
        return rows.filter(F.col("toxic") == toxic).select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    # all words of enough toxic documents are ranked by their odds, in Spark; only those that make the lexicon leave it
    pos, neg = counts(1).filter(f"word = '' OR n >= {LEAST_DOCUMENTS}"), counts(0).withColumnRenamed("n", "m")
    both = written(pos.join(neg, "word", "left").select("word", "n", F.coalesce("m", F.lit(0)).alias("m")), "words")
    docs = both.filter("word = ''").first()
    n_pos, n_neg = (docs.n, docs.m) if docs else (0, 0)
    odds = F.log((F.col("n") + 0.5) / (n_pos + 1.0)) - F.log((F.col("m") + 0.5) / (n_neg + 1.0))
    ranks = both.filter("word <> ''").withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    top = ranks.orderBy(F.desc(F.col("odds") * F.sqrt("n")), "word").limit(LEXICON).select("word", "odds").collect()
    forget(both)
    lexicon = FIXED | {r.word: (INSULT, r.odds) for r in top if r.word not in FIXED}

    @F.arrow_udf("array<double>")
    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, lexicon) for b in blocks(texts) for t in b], type=pa.list_(pa.float64()))

    # equal feature rows are counted together: the driver gets the few distinct ones, at most about FIT_ROWS
    equal = written(rows.select(extract("text").alias("x"), "toxic").groupBy("x").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")), "features")
    seen = bounded_sample(equal, FIT_ROWS, 7).collect()
    forget(equal)
    seen.sort(key=lambda r: r.x)  # sums in one order, so that reruns agree
    x = np.array([r.x for r in seen], dtype=float).reshape(-1, N_FEATURES)
    toxic, n = (np.array([r[c] for r in seen], dtype=float) for c in ("pos", "n"))
    weights = logistic(scaled(x), toxic, n) if 0 < toxic.sum() < n.sum() else np.r_[np.zeros(N_FEATURES), math.log((toxic.sum() + 0.5) / (n.sum() - toxic.sum() + 0.5))]
    return {"lexicon": lexicon, "weights": weights}


def scorer(model: dict):
    """Column -> Column: the score of a text, 0 to 1.

    Null and empty texts match no clause, and get the score of texts without a match; a text's score depends on nothing
    but the text, so repeated rows are equal; long texts are read whole."""
    lexicon, weights = model["lexicon"], model["weights"]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t, lexicon) for b in blocks(texts) for t in b], dtype=float).reshape(-1, N_FEATURES)
        z = scaled(x) @ weights[:-1] + weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), type=pa.float64())

    def of(text: Column) -> Column:
        return score(text)

    return of
