"""Vectors from the driver's memory, and results in matrix form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def from_arrays(spark: SparkSession, vectors: np.ndarray, keys: np.ndarray | None = None) -> DataFrame:
    """(key, vector) of a rows x dimensions array (a single vector is one row); keys count from 0 if not given. Any strides; the scalars' kind is kept, half floats become floats."""
    x = np.atleast_2d(np.asarray(vectors))
    x = np.ascontiguousarray(x.astype(np.float32) if x.dtype == np.float16 else x)
    key = np.arange(len(x)) if keys is None else np.asarray(keys, dtype=np.int64)
    if len(key) != len(x):
        raise ValueError("as many keys as vectors are needed")
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return spark.createDataFrame(pa.table({"key": pa.array(key.astype(np.int64)), "vector": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))}))


def padded(found: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, keys, distances, counts) of a result (query_id, rank, key, distance): queries x k, unused places hold key 0 and NaN.

    The driver holds the result; it is for result sets that fit it."""
    t = found.select("query_id", "rank", "key", "distance").toArrow()
    q, place = t["query_id"].to_numpy(), t["rank"].to_numpy() - 1
    ids, row = np.unique(q, return_inverse=True)
    keys, distances = np.zeros((len(ids), k), dtype=np.int64), np.full((len(ids), k), np.nan)
    use = place < k
    keys[row[use], place[use]], distances[row[use], place[use]] = t["key"].to_numpy()[use], t["distance"].to_numpy()[use]
    return ids, keys, distances, np.bincount(row[use], minlength=len(ids))
