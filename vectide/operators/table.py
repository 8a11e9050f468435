"""A keyed vector table: immutable DataFrames behind add, remove, rename, get and search."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.quantize import cast
from vectide.operators import cluster as clusters
from vectide.operators import knn
from vectide.operators.join import stable_match
from vectide.sources.folder import drop_folder, hadoop_path, names_in


@dataclass(frozen=True)
class Config:
    ndim: int
    metric: str = "cos"
    dtype: str = "f32"
    multi: bool = False


class VectorTable:
    """rows (key, vector). Methods return new tables; a table that is a view refuses changes."""

    def __init__(self, config: Config, rows: DataFrame, immutable: bool = False):
        self.config, self.rows, self.immutable = config, rows, immutable

    @classmethod
    def empty(cls, spark: SparkSession, config: Config) -> VectorTable:
        return cls(config, spark.createDataFrame([], "key long, vector array<float>"))

    def _new(self, rows: DataFrame) -> VectorTable:
        if self.immutable:
            raise ValueError("a view can't be changed")
        return VectorTable(self.config, rows)

    def add(self, rows: DataFrame, check: bool = True) -> VectorTable:
        """Rows with (key, vector); a wrong dimension, or a known or repeated key in a table that isn't multi, raises."""
        rows = rows.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<float>").alias("vector"))
        if check:
            if not rows.filter(F.size("vector") != self.config.ndim).isEmpty():
                raise ValueError(f"vectors must have {self.config.ndim} dimensions")
            if not self.config.multi and not (rows.join(self.rows, "key", "left_semi").isEmpty() and rows.groupBy("key").count().filter("count > 1").isEmpty()):
                raise ValueError("a key is known already, or given twice")
        return self._new(self.rows.unionByName(rows))

    def append(self, vectors: DataFrame) -> VectorTable:
        """Vectors without keys get the keys from the number of rows on, in the order of their partitions; a key that is known raises, as in add."""
        start, rows = len(self), vectors.select("vector", F.monotonically_increasing_id().alias("id"))
        # an id is the partition's number and the row's place in it; one row a partition says where it starts
        part, sizes = F.shiftright("id", 33), Window.partitionBy(F.lit(0)).orderBy("part")
        counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = counts.select("part", (F.sum("n").over(sizes) - F.col("n")).alias("before"))
        rows = rows.withColumn("part", part).join(F.broadcast(before), "part")
        return self.add(rows.select((F.lit(start) + F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("key"), "vector"))

    def update(self, rows: DataFrame, insert: bool = False) -> VectorTable:
        """New vectors for known keys: all vectors of a key are replaced by those given. An unknown key raises, or is added with `insert`."""
        rows = rows.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<float>").alias("vector"))
        if not insert and not rows.join(self.rows, "key", "left_anti").isEmpty():
            raise ValueError("a key isn't known")
        return self.remove(rows).add(rows)

    def remove(self, keys: DataFrame) -> VectorTable:
        return self._new(self.rows.join(keys.select("key").distinct(), "key", "left_anti"))

    def rename(self, names: DataFrame) -> VectorTable:
        """names (old, new); in a table that isn't multi a new name that is in use, or given twice, raises."""
        names = names.select("old", "new").distinct()
        if not self.config.multi and not (names.join(self.rows, F.col("new") == F.col("key"), "left_semi").isEmpty() and names.groupBy("new").count().filter("count > 1").isEmpty()):
            raise ValueError("the new key is in use")
        return self._new(self.rows.join(names, F.col("key") == F.col("old"), "left").select(F.coalesce("new", "key").alias("key"), "vector"))

    def get(self, keys: DataFrame, dtype: str = "f32") -> DataFrame:
        """(key, vector), null where a key is missing; all vectors of a key in a multi table; as any of the kinds of quantize.cast."""
        return keys.select("key").join(self.rows, "key", "left").withColumn("vector", cast(F.col("vector"), "f32", dtype, self.config.ndim))

    def contains(self, keys: DataFrame) -> DataFrame:
        have = self.rows.select("key").distinct().withColumn("found", F.lit(True))
        return keys.select("key").join(have, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))

    def count(self, keys: DataFrame) -> DataFrame:
        have = self.rows.groupBy("key").agg(F.count("*").alias("n"))
        return keys.select("key").join(have, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))

    def __len__(self) -> int:
        return self.rows.count()

    def keys(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """A slice of the keys in ascending order."""
        out = self.rows.select("key").orderBy("key").offset(start)
        return out if stop is None else out.limit(max(0, stop - start))

    def search(self, queries: DataFrame, k: int, **how) -> DataFrame:
        return knn.search(queries, self.rows, k, self.config.metric, **how)

    def pairwise(self, pairs: DataFrame) -> DataFrame:
        return knn.pairwise(self.rows, self.rows, pairs, self.config.metric)

    def distances(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query_id, key, n, mean, min, max) of query vectors to all vectors of a key."""
        return knn.key_distances(queries, self.rows, pairs, self.config.metric)

    def join(self, other: VectorTable, proposals: int | None = None) -> DataFrame:
        """The smaller side proposes; the result is from this table to the other."""
        if len(self) <= len(other):
            return stable_match(self.rows, other.rows, self.config.metric, proposals)
        return stable_match(other.rows, self.rows, self.config.metric, proposals).select(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key"), "distance")

    def cluster(self, min_count: int = 0, max_count: int | None = None, **how) -> DataFrame:
        return clusters.cluster(self.rows, min_count, max_count, self.config.metric, **how)

    def stats(self, connectivity: int = 16) -> DataFrame:
        return clusters.level_stats(self.rows, connectivity)

    def with_metric(self, metric: str) -> VectorTable:
        return VectorTable(replace(self.config, metric=metric), self.rows, self.immutable)

    def copy(self) -> VectorTable:
        return VectorTable(self.config, self.rows)

    def fork(self) -> VectorTable:
        """An empty table of the same configuration."""
        return VectorTable(self.config, self.rows.limit(0))

    def memory_usage(self) -> int:
        """Bytes of keys and vectors at the configured kind."""
        bits = {"f64": 64, "f32": 32, "f16": 16, "bf16": 16, "i8": 8, "b1": 1}[self.config.dtype]
        return len(self) * (8 + -(-self.config.ndim * bits // 8))

    @property
    def capacity(self) -> int:
        """A table takes any number of rows; what it holds is what it has room for."""
        return len(self)

    def clear(self) -> VectorTable:
        return self._new(self.rows.limit(0))

    def compact(self, partitions: int) -> VectorTable:
        return self._new(self.rows.repartitionByRange(partitions, "key").sortWithinPartitions("key"))

    def save(self, path: str) -> None:
        """A new version below path: Parquet rows in key order, and a small text with the metadata, which is written last and makes the version count.

        The version before stays, as tables that were loaded from it may still read it (this one, too); older ones go."""
        spark = self.rows.sparkSession
        known = self._versions(spark, path)
        at = f"{path}/v{(known[-1] + 1 if known else 0):09}"
        drop_folder(spark, at)  # what a failed save left
        self.rows.sortWithinPartitions("key").write.parquet(f"{at}/rows")
        meta = asdict(self.config) | {"size": spark.read.parquet(f"{at}/rows").count()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/meta")
        for old in known[:-1]:
            drop_folder(spark, f"{path}/v{old:09}")

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        """Numbers of the whole versions at path, ascending."""
        return [int(v[1:]) for v in names_in(spark, path) if v[:1] == "v" and v[1:].isdigit() and "_SUCCESS" in names_in(spark, f"{path}/{v}/meta")]

    @classmethod
    def _newest(cls, spark: SparkSession, path: str) -> str:
        if not (known := cls._versions(spark, path)):
            raise FileNotFoundError(path)
        return f"{path}/v{known[-1]:09}"

    @classmethod
    def serialized_length(cls, spark: SparkSession, path: str) -> int:
        """Bytes of the newest saved version."""
        fs, at = hadoop_path(spark, cls._newest(spark, path))
        return fs.getContentSummary(at).getLength()

    @classmethod
    def metadata(cls, spark: SparkSession, path: str) -> dict:
        return json.loads(spark.read.text(f"{cls._newest(spark, path)}/meta").first().value)

    @classmethod
    def load(cls, spark: SparkSession, path: str, view: bool = False) -> VectorTable:
        """The newest saved version; a view is read lazily and can't be changed. A missing path raises FileNotFoundError."""
        at = cls._newest(spark, path)
        meta = json.loads(spark.read.text(f"{at}/meta").first().value)
        meta.pop("size")
        rows = spark.read.parquet(f"{at}/rows")
        return cls(Config(**meta), rows if view else rows.cache(), immutable=view)

    @classmethod
    def merge_paths(cls, spark: SparkSession, paths: list[str]) -> VectorTable:
        """The rows of saved tables as one table to search; keys that several hold stay apart."""
        tables = [cls.load(spark, p, view=True) for p in paths]
        rows = tables[0].rows
        for t in tables[1:]:
            if t.config.ndim != tables[0].config.ndim or t.config.metric != tables[0].config.metric:
                raise ValueError("the tables differ in dimensions or metric")
            rows = rows.unionByName(t.rows)
        return cls(replace(tables[0].config, multi=True), rows, immutable=True)

    @classmethod
    def restore(cls, spark: SparkSession, path: str, view: bool = False) -> VectorTable | None:
        """The saved table; None where there is none."""
        return cls.load(spark, path, view) if cls._versions(spark, path) else None
