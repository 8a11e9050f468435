"""The registered queries of these operators, with production parameters, over whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontamination, language_id, mixing, quality_classifier, quality_rules, secrets, simhash_dedup, token_counts, token_output, toxicity
from vectide.llm.common import held_out, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> dict:
    """Learned from the labelled documents that aren't held out; if they are more than FIT_ROWS, from those of about so many ids.

    The labels, one an id, then are a table of bounded size, which is broadcast, so texts aren't shuffled."""
    labels = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(texts.join(F.broadcast(toxicity.sampled(labels)), "doc_id").select("text", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents; nulls, empty, long and repeated texts: see toxicity.scorer."""
    score = toxicity.scorer(toxicity_model(spark, sf_dir))
    rows = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return found.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_token_output, op4_language, op5_decontamination, op6_quality_rules, op7_quality_classifier, op8_token_counts, op9_toxicity, op10_simhash)}

_W = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op2_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM s),
-- each round clamps the sources above their cap and deals the rest anew
fill(round, capped, lvl) AS (
  SELECT 0, []::VARCHAR[], (SELECT 1.5 * sum(source_size) / sum(w) FROM n)::DOUBLE
  UNION ALL
  SELECT round + 1, c, (SELECT (t.total - coalesce(sum(2.0 * source_size) FILTER (list_contains(c, coalesce(source, '\0'))), 0)) / nullif(sum(w) FILTER (NOT list_contains(c, coalesce(source, '\0'))), 0) FROM n)
  FROM (SELECT round, capped, lvl, (SELECT coalesce(list(coalesce(source, '\0')), []) FROM n WHERE w * lvl > 2.0 * source_size OR list_contains(capped, coalesce(source, '\0'))) AS c FROM fill) f,
       (SELECT 1.5 * sum(source_size) AS total FROM n) t
  WHERE len(c) > len(capped)),
f AS (SELECT * FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN list_contains(capped, coalesce(source, '\0')) THEN 2.0 * source_size ELSE w * lvl END AS target FROM n, f),
p AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS whole, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
k AS (SELECT source, key, sum(size)::BIGINT AS den, (sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size))::BIGINT AS before FROM d GROUP BY source, key)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (whole * d.size + CASE WHEN k.before + k.den <= rest THEN d.size WHEN k.before >= rest THEN 0 ELSE d.size * (rest - k.before) // k.den END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key""",
}
