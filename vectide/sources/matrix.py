"""Matrix files: a header of two 32-bit counts (rows, columns), then the scalars row by row.

Files are read by row ranges in parallel: each task opens its file, seeks and reads, through pyarrow's file systems
(local, hdfs, s3, gs). A table is written as one file a partition, in key order."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.quantize import cast, with_norm

KINDS = {"fbin": "<f4", "f32bin": "<f4", "dbin": "<f8", "hbin": "<f2", "ibin": "<i4", "i32bin": "<i4", "bbin": "<u1", "i8bin": "<i1"}


def kind_of(path: str) -> np.dtype:
    try:
        return np.dtype(KINDS[path.rsplit(".", 1)[-1]])
    except KeyError:
        raise ValueError(f"unknown matrix suffix: {path}") from None


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path else (files.FileSystem.from_uri("file://" + path.removeprefix("file:"))[0], path.removeprefix("file:"))


def matrix_files(path: str) -> list[tuple[str, int, int, int]]:
    """(path, first row, rows, columns) of the matrix files at path, a file or a folder, in the order of their names; none where there is nothing."""
    system, at = _at(path)
    info = system.get_file_info(at)
    if info.type == files.FileType.NotFound:
        return []
    found = [info] if info.type == files.FileType.File else sorted((f for f in system.get_file_info(files.FileSelector(at)) if f.type == files.FileType.File and f.extension in KINDS), key=lambda f: f.path)
    out, first = [], 0
    for f in found:
        kind = kind_of(f.path)
        with system.open_input_file(f.path) as h:
            rows, cols = struct.unpack("<ii", h.read(8))
        if f.size != 8 + rows * cols * kind.itemsize:
            raise ValueError(f"{f.path}: the size doesn't fit its header")
        out.append((f.path, first, rows, cols))
        first += rows
    return out


SPARK_KINDS = {"f": "float", "d": "double", "e": "float", "i": "int", "B": "int", "b": "tinyint"}


def load_matrix(spark: SparkSession, path: str, start_row: int = 0, count_rows: int | None = None, rows_a_task: int = 1 << 18) -> DataFrame | None:
    """(key, vector): rows of all matrix files at path, numbered through from 0 in the order of the file names; a slice of them.

    Vectors have the file's kind (half floats as floats, unsigned bytes as ints). None where there is no file."""
    found = matrix_files(path)
    if not found:
        return None
    kind = kind_of(found[0][0])
    total = found[-1][1] + found[-1][2]
    stop = total if count_rows is None else min(total, start_row + count_rows)
    ranges = [(p, a, cols, lo, min(lo + rows_a_task, a + rows, stop)) for p, a, rows, cols in found for lo in range(max(a, start_row), min(a + rows, stop), rows_a_task)]
    element, root = SPARK_KINDS[kind.char], path

    def decode(batches):
        system, _ = _at(root)
        target = {"float": np.float32, "double": np.float64, "int": np.int32, "tinyint": np.int8}[element]
        for b in batches:
            for r in b.to_pylist():
                width = r["cols"] * kind.itemsize
                with system.open_input_file(r["path"]) as h:
                    for lo in range(r["lo"], r["hi"], step := max(1, (8 << 20) // max(1, width))):
                        n = min(step, r["hi"] - lo)
                        h.seek(8 + (lo - r["first"]) * width)
                        x = np.frombuffer(h.read(n * width), dtype=kind).astype(target)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * r["cols"]), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), lists], names=["key", "vector"])

    tasks = spark.createDataFrame(ranges, "path string, first long, cols int, lo long, hi long")
    return tasks.repartition(max(1, min(len(ranges), 10_000)), "path", "lo").mapInArrow(decode, f"key long, vector array<{element}>")


def save_matrix(rows: DataFrame, path: str, suffix: str = "fbin") -> None:
    """rows (key, vector) as a file a partition in the folder path, in key order; the suffix gives the scalars.

    A file is written under another name and then renamed, so a task that is run again leaves one file. An old folder's matrix files are replaced."""
    kind = kind_of(f"x.{suffix}")
    system, at = _at(path)
    system.create_dir(at)
    run = uuid.uuid4().hex[:8]

    def encode(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name, n, cols = f"{at}/part-{run}-{context.partitionId():06}", 0, 0
        system, _ = _at(path)
        own, body = f"{name}.{context.taskAttemptId()}.tmp", f"{name}.{context.taskAttemptId()}.body"
        with system.open_output_stream(body) as h:
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind)
                if b.num_rows:
                    lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
                    if (lengths != (cols or lengths[0])).any():
                        raise ValueError("vectors have different numbers of dimensions")
                    cols, n = int(lengths[0]), n + b.num_rows
                h.write(x.tobytes())
        if n:
            with system.open_output_stream(own) as h, system.open_input_stream(body) as source:
                h.write(struct.pack("<ii", n, cols))
                while part := source.read(8 << 20):
                    h.write(part)
            system.move(own, f"{name}.{suffix}")
        system.delete_file(body)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ordered = rows.filter("vector IS NOT NULL").orderBy("key").select("vector")
    old = [f.path for f in system.get_file_info(files.FileSelector(at)) if f.type == files.FileType.File and f.extension in KINDS]
    ordered.mapInArrow(encode, "n long").agg(F.sum("n")).collect()
    for f in old:
        system.delete_file(f)


def random_vectors(spark: SparkSession, count: int, ndim: int, kind: str = "ip", seed: int = 0, dtype: str = "f64") -> DataFrame:
    """(key, vector): uniform in [0, 1), of unit length for ip, as any of the kinds of quantize.cast (i8: times 100), the same for a seed."""
    if dtype != "f64":
        rows = random_vectors(spark, count, ndim, kind, seed)
        if dtype == "i8":
            return rows.withColumn("vector", F.transform("vector", lambda x: (x * 100).cast("tinyint")))
        middle = F.transform("vector", lambda x: x - 0.5) if dtype == "b1" else F.col("vector")
        return rows.withColumn("vector", cast(middle, "f64", dtype, ndim))
    u = F.transform(F.sequence(F.lit(0), F.lit(ndim - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 30)) / float(1 << 30))
    rows = spark.range(count).select(F.col("id").alias("key"), u.alias("vector"))
    if kind != "ip":
        return rows
    return rows.withColumn("vector", with_norm(F.col("vector"), lambda x, norm: x / F.greatest(norm, F.lit(1e-30))))
