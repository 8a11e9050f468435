"""A training-data pipeline: toxicity, near duplicates, benchmark passages, mixing, token output.

Each stage takes all that the one before kept, as Parquet in the shared folder, and its decisions take effect.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns, which go
through untouched (the last stage's result has none)."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontamination, mixing, queries, simhash_dedup, token_output, toxicity
from vectide.llm.common import _WRITTEN, bounded_batches, drop_folder, forget_since, shared_folder, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Null and empty texts match no clause and get the score of a text without a match."""
    bounded_batches(spark)
    score = toxicity.scorer(queries.toxicity_model(spark, sf_dir))
    return docs.filter(score(F.coalesce("text", F.lit(""))) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; see simhash_dedup.keep_one for null and repeated ids.

    Null and empty texts are one group."""
    bounded_batches(spark)
    return simhash_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that is mostly such passages goes. Null and empty texts stay as they are."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; a row for each time. Texts without words come as often as their source's whole
    repetitions, which may be never; a null source is a source."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written in the token format and read back: (doc_id, start, n_tokens, ids_crc32). A null text is the end id alone; null ids come first."""
    return token_output.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", source_mix),
    ("token_output", token_files),
]
ORACLE_SQL = None  # the scorer, the links and the tokenizer aren't SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    last = None
    for name, stage in STAGES:
        mark = len(_WRITTEN)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        forget_since(mark)
        if last:
            drop_folder(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return docs
