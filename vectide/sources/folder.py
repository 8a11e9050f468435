"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's below spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base}/vectide-{spark.sparkContext.applicationId}"
    fs, at = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, at = hadoop_path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, cut from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectide_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing will read again."""
    for df in tables:
        drop_folder(df.sparkSession, df._vectide_path)
