"""Streams of vectors: keyed upserts, and stream-to-table neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vectide.functions.metrics import ALIASES, metric
from vectide.operators.knn import MATRIX, near


def upserts(stream: DataFrame, path: str) -> DataStreamWriter:
    """Write each batch of (key, seq, vector) as a version below path; latest() reads the newest vector of each key.

    A batch that is written again after a failure replaces its own folder, so each row counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select("key", "seq", "vector").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put)


def latest(rows: DataFrame) -> DataFrame:
    """(key, vector): the row with the highest seq of each key; null vectors delete."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1 AND vector IS NOT NULL").select("key", "vector")


def within(stream: DataFrame, table: DataFrame, bucket: str, radius: float, kind: str = "cos") -> DataFrame:
    """Neighbours within radius of streamed (query_id, vector, bucket) rows among a static table's rows of the same bucket.

    Where the rows are no stream, they are a query set: with a matrix form, blocks of it are broadcast as in a search, and the table stays where it is."""
    if not stream.isStreaming and ALIASES.get(kind, kind) in MATRIX:
        return near(stream, table, bucket, radius, kind)
    q = stream.select("query_id", F.col("vector").alias("q"), bucket)
    return q.join(table, bucket).select("query_id", "key", metric(kind)(F.col("q"), F.col("vector")).alias("distance")).filter(F.col("distance") <= radius)
