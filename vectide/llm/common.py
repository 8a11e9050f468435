"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row batch handed to Python holds at most about so many bytes, however long single texts are.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, of each batch that goes to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """Rows set aside for evaluation: crc32 of the id as text, modulo 5, is 0 (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(rows: DataFrame, most: int, seed: int, copies: bool = False) -> DataFrame:
    """About `most` of the different rows, chosen by their hash, so alike for any layout; all different rows if there are no more than that.

    Equal rows count once, so one that makes up a third of the table adds one; with `copies` they stay (for fits that
    never gather the sample)."""
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 30)) < int((1 << 30) * most / total))
    return rows if copies else rows.distinct()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's below spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base}/vectide-{spark.sparkContext.applicationId}"
    hadoop_path(spark, path)[0].deleteOnExit(hadoop_path(spark, path)[1])
    return path


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


_WRITTEN: list[DataFrame] = []  # tables that written() made and nobody forgot


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, cut from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectide_path = path
    _WRITTEN.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Remove a table made by written() that nothing will read again."""
    drop_folder(df.sparkSession, df._vectide_path)
    _WRITTEN[:] = [w for w in _WRITTEN if w is not df]


def forget_since(mark: int) -> None:
    """Remove the tables made since len(_WRITTEN) was mark; for callers whose own result is stored by then."""
    for df in _WRITTEN[mark:]:
        forget(df)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give freed memory of earlier batches back; workers are reused, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of a batch (null: empty) in blocks of about `most` characters at most, or one text."""
    release()
    block, n = [], 0
    for text in texts:
        text = text.as_py() or ""
        if block and n + len(text) > most:
            yield block
            block, n = [], 0
        block.append(text)
        n += len(text)
    if block:
        yield block
