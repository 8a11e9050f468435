"""Secret scans: base patterns, and strings that character Markov models find random.

Native: DataFrame and SQL expressions only. Positions of matches come from one pass of `gap, match` pairs over a text:
the pattern `(anything, lazily)(match)` or the end of the text always succeeds, so the pass is linear, and running
sums of the pieces' lengths are the positions.

Method: two first-order Markov models over ASCII characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples by counting character pairs (add-one smoothing). A candidate, a run of 20 or more of
[A-Za-z0-9+/_=.-] with a letter and 8 different characters that no base span touches, is a secret if the log-likelihood ratio of the
two models is over `threshold` a character pair, and by LETTERS_ONLY more if it has no digit. The ratios are one constant array of 128 x 128 doubles.

Samples: the random ones are digests and base64 of a counter, the ordinary ones are joined from common parts of identifiers in several
styles, and rules, dates, versions and UUIDs; all are made by rule, a fixed number of rows, and another labelled table (sample, random) can be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the task: the base patterns, in their order; and the least length of what group `value` (0: all) matched.
BASE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
}
#: The same matches where short ones needn't be walked over: a run that is too short holds no longer one.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
CANDIDATE, THRESHOLD = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}", 0.6
DISTINCT, LETTERS_ONLY = 8, 0.5
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"  # names things, and hides nothing
PARTS = "get set user name file path load save index count value key list map node tree data base config path http request response handler parser token stream buffer read write open close main test item order total price date time update create delete select from where join group table column row page view model train batch size text word line char string number result error message event queue task worker thread process memory cache server client port host address version module package import export public private static class object type method function param option default".split()
STYLES = 6


def samples(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """Labelled samples (sample, random): n of either kind, the same each time."""
    i, parts = F.col("id"), F.array(*[F.lit(p) for p in PARTS])
    digest = F.sha2(F.concat(F.lit("s"), i.cast("string")), 256)
    hexed = F.substring(digest, 1, 40)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = F.when(i % 4 == 0, hexed).when(i % 4 == 1, F.upper(F.substring(F.conv(F.substring(digest, 1, 15), 16, 36), 1, 20))).otherwise(coded)
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    a, b, c, d = map(part, range(4))
    style = [F.concat_ws("_", a, b, c, d), F.concat_ws("-", a, b, c, d), F.concat_ws(".", a, b, c, d), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)), F.concat_ws("/", a, b, c, d), F.upper(F.concat_ws("_", a, b, c))]
    plain = F.element_at(F.array(*style), (i % STYLES + 1).cast("int"))
    plain = F.when(i % 5 == 0, F.concat(plain, F.lit("_"), (1990 + i % 40).cast("string"))).otherwise(plain)
    rule = F.concat(F.repeat(F.element_at(F.array(*[F.lit(c) for c in "-=_./"]), (i % 5 + 1).cast("int")), (i % 30 + 10).cast("int")), a)
    date = F.concat_ws("-", (1990 + i % 40).cast("string"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), a)
    version = F.concat(a, F.lit("-"), (i % 9).cast("string"), F.lit("."), (i % 17).cast("string"), F.lit("."), (i % 23).cast("string"))
    plain = F.when(i % 11 == 0, rule).when(i % 11 == 1, date).when(i % 11 == 2, version).otherwise(plain)
    ids = spark.range(0, n, 1, 1)
    return ids.select(random.alias("sample"), F.lit(1).alias("random")).unionByName(ids.select(plain.alias("sample"), F.lit(0).alias("random")))


def train(labelled: DataFrame) -> str:
    """128 x 128 log ratios, comma-joined, from labelled samples; null samples and pairs outside ASCII are left out.

    The driver gets at most 16,384 counts."""
    pairs = labelled.filter("length(sample) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda k: F.ascii(F.substr("sample", k, F.lit(1))) * 128 + F.ascii(F.substr("sample", k + 1, F.lit(1))))).alias("pair"))
    counts = pairs.filter("pair BETWEEN 0 AND 16383 AND random IS NOT NULL").groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o")).collect()
    from math import log

    used = sorted({c for row in counts for c in divmod(row.pair, 128)})
    seen = {row.pair: (row.r, row.o) for row in counts}
    out = [0.0] * 16384
    for a in used:
        r, o = (sum(seen.get(a * 128 + b, (0, 0))[k] for b in used) for k in (0, 1))
        for b in used:
            x, y = seen.get(a * 128 + b, (0, 0))
            out[a * 128 + b] = log((x + 1) / (r + len(used))) - log((y + 1) / (o + len(used)))
    return ",".join(f"{v:.4f}" for v in out)


def _spans(text: Column, kind: str, pattern: str, accept) -> Column:
    """array<struct<start, kind, stop>> of the leftmost non-overlapping matches that accept(match) holds for."""
    walk = F.lit(rf"([\s\S]*?)(?:({pattern})|\z)")
    gaps, found = F.regexp_extract_all(text, walk, F.lit(1)), F.regexp_extract_all(text, walk, F.lit(2))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    # running sums in groups of 512 pieces, then over groups: arrays are copied when they grow
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(acc, p):
        start = acc["pos"] + F.length(p["gap"])
        stop = start + F.length(p["match"])
        return F.struct(stop.alias("pos"), F.when(F.length(p["match"]) > 0, F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), p["match"].alias("match"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / 512).cast("int")), lambda g: F.aggregate(F.slice(pieces, g * 512 + 1, F.lit(512)), start, step))
    ends = F.struct(F.lit(0).alias("base"), F.array().cast("array<array<struct<start:int,stop:int,match:string>>>").alias("out"))

    def join(acc, g):
        return F.struct((acc["base"] + g["pos"]).alias("base"), F.concat(acc["out"], F.array(F.transform(g["out"], lambda m: F.struct((m["start"] + acc["base"]).alias("start"), (m["stop"] + acc["base"]).alias("stop"), m["match"].alias("match"))))).alias("out"))

    matches = F.flatten(F.aggregate(groups, ends, join)["out"])
    matches = F.filter(matches, lambda m: accept(m["match"]))
    spans = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit([*BASE, "markov"].index(kind)).alias("kind"), m["stop"].alias("stop")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))  # most texts have none


def _random(match: Column, table: str, threshold: float) -> Column:
    """At least DISTINCT characters, a letter among them, and the mean log ratio of its pairs is over threshold (plus LETTERS_ONLY without a digit); not a UUID."""
    ratios = F.split(F.lit(table), ",").cast("array<double>")

    def judge(codes):
        pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.coalesce(F.element_at(ratios, a * 128 + b + 1), F.lit(0.0)))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
        least = threshold + F.when(match.rlike("[0-9]"), 0.0).otherwise(LETTERS_ONLY)
        return (F.size(F.array_distinct(codes)) >= DISTINCT) & (total / (F.size(codes) - 1) > least)

    codes = F.transform(F.split(match, ""), F.ascii)  # once, as a variable of the outer function: positions then are looked up, not counted
    return match.rlike("[A-Za-z]") & ~match.rlike(UUID) & F.element_at(F.transform(F.array(codes), judge), 1)


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*BASE, "markov"]])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, table: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row of docs (doc_id, text; other columns aren't read).

    Spans are kind:start:end in code points, end exclusive, by start, then kind as listed (assign, access, hex,
    markov). A null text is empty and has none; repeated rows stay repeated."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.regexp_extract(m, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    accept = {"assign": lambda m: F.length(value(m)) >= BASE["assign"][1]} | {k: (lambda m, n=BASE[k][1]: F.length(m) >= n) for k in ("access", "hex")}
    random = lambda m: _random(m, table, threshold)
    rows = docs.select("doc_id", *[_spans(text, k, LONG.get(k, BASE[k][0]), accept[k]).alias(k) for k in BASE], _spans(text, "markov", CANDIDATE, random).alias("extra"))
    rows = rows.select("doc_id", *BASE, F.concat(*BASE).alias("base"), "extra")
    free = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))
    rows = rows.withColumn("extra", free)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_markov"))
