"""Token counts: batch encoding in Arrow functions that return lengths only.

Spark cuts batches by bytes (common.BATCH_BYTES); within a batch, blocks of about 2 million characters are encoded; long texts are cut
at boundaries that no token crosses (see encoding.py). Ids never leave the worker."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches
from vectide.llm.encoding import encoder


def token_count(path: str):
    """Column -> Column: the number of tokens the vocabulary file at `path` gives a text, without added special tokens."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path, "count").encode
        return pa.array([sum(encode(t)) for b in blocks(texts) for t in b], type=pa.int64())

    def of(text: Column) -> Column:
        return count(text)

    return of


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text; other columns aren't read).

    Null and empty texts have no bytes and no tokens; repeated rows stay repeated; special tokens' strings inside a
    text count as the library reads them by default."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(path)(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
