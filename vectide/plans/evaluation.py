"""Timing and quality of a table on a dataset: rows, queries, and the keys that a search should find."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import quality
from vectide.operators.table import Config, VectorTable
from vectide.sources.matrix import load_matrix, random_vectors


@dataclass
class Dataset:
    """rows (key, vector), queries (query_id, vector), expected (query_id, key)."""

    rows: DataFrame
    queries: DataFrame
    expected: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, vectors: str | None = None, queries: str | None = None, expected: str | None = None, count: int = 1024, ndim: int = 64, metric: str = "ip", seed: int = 0) -> Dataset:
        """From matrix files, or of random vectors. Without queries the rows are the queries; without expected keys a query should find itself.

        expected: a matrix of keys, a row for each query, nearest first."""
        rows = random_vectors(spark, count, ndim, metric, seed) if vectors is None else load_matrix(spark, vectors)
        asked = rows if queries is None else load_matrix(spark, queries)
        if rows is None or asked is None:
            raise FileNotFoundError(vectors if rows is None else queries)
        asked = asked.select(F.col("key").alias("query_id"), "vector")
        if expected is None:
            known = asked.select("query_id", F.col("query_id").alias("key"))
        else:
            known = load_matrix(spark, expected).select(F.col("key").alias("query_id"), F.explode("vector").alias("key")).withColumn("key", F.col("key").cast("long"))
        return cls(rows, asked, known)

    def crop(self, most: int) -> Dataset:
        """The first rows, up to `most`, and the expected keys among them."""
        rows = self.rows.filter(F.col("key") < most)
        return Dataset(rows, self.queries, self.expected.filter(F.col("key") < most))


@dataclass
class Result:
    seconds: dict[str, float] = field(default_factory=dict)
    a_second: dict[str, float] = field(default_factory=dict)
    recall: float | None = None


def evaluate(table: VectorTable | Config, data: Dataset, k: int = 10, tasks: Iterable[str] = ("add", "search"), find: Callable[[VectorTable, DataFrame, int], DataFrame] | None = None) -> Result:
    """Runs the tasks in order: add checks and stores the rows, search finds k for each query. find: another search than the table's own."""
    table = VectorTable.empty(data.rows.sparkSession, table) if isinstance(table, Config) else table
    out = Result()
    for task in tasks:
        began = time.monotonic()
        if task == "add":
            table = table.add(data.rows)
            n = len(table)
        elif task == "search":
            found = (find or (lambda t, q, m: t.search(q, m)))(table, data.queries, k)
            out.recall = quality.mean_recall(found, data.expected).first().recall
            n = data.queries.count()
        else:
            raise ValueError(f"unknown task: {task}")
        out.seconds[task] = time.monotonic() - began
        out.a_second[task] = n / max(out.seconds[task], 1e-9)
    return out
