"""Casts between vector kinds: 8-bit integers, bits, and half floats (kept as rounded floats)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def with_norm(v: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(x, norm) of each x of v; the norm is computed once a vector, not once an element."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.element_at(F.transform(F.array(F.struct(v.alias("v"), norm.alias("norm"))), lambda s: F.transform(s["v"], lambda x: f(x, s["norm"]))), 1)


def to_i8(v: Column) -> Column:
    """Unit length, times 127, towards zero, within 127; a zero vector stays zero."""
    return with_norm(v, lambda x, norm: F.when(norm == 0, 0.0).otherwise(F.greatest(F.least(x * 127 / F.nullif(norm, F.lit(0.0)), F.lit(127.0)), F.lit(-127.0))).cast("tinyint"))


def from_i8(v: Column) -> Column:
    return F.transform(v, lambda x: (x / F.lit(127.0)).cast("float"))


def to_bits(v: Column) -> Column:
    """1 where positive, in 64-bit words, the first dimension at the highest bit."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    padded = F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), 64))
    word = lambda w: F.aggregate(F.slice(padded, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.when(F.size(v) > 0, F.transform(words, word)).otherwise(F.array().cast("array<long>"))


def _flat(vectors: pa.Array, f) -> pa.Array:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())].astype(np.int32)), pa.array(f(flat), type=pa.float32()))
    return pa.compute.if_else(vectors.is_valid(), lists, pa.scalar(None, lists.type)) if vectors.null_count else lists


@F.arrow_udf(ArrayType(FloatType()))
def to_f16(vectors: pa.Array) -> pa.Array:
    """Rounded to IEEE half precision."""
    return _flat(vectors, lambda x: x.astype(np.float16).astype(np.float32))


@F.arrow_udf(ArrayType(FloatType()))
def to_bf16(vectors: pa.Array) -> pa.Array:
    """Truncated to the upper 16 bits of a float."""
    return _flat(vectors, lambda x: (x.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32))


def from_bits(words: Column, ndim: int) -> Column:
    """0 or 1 for each of ndim dimensions."""
    word = lambda i: F.element_at(words, (F.floor(i / 64) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(ndim - 1)), lambda i: F.call_function("shiftrightunsigned", word(i), (F.lit(63) - F.pmod(i, F.lit(64))).cast("int")).bitwiseAND(F.lit(1)).cast("float"))


KINDS = ("f64", "f32", "f16", "bf16", "i8", "b1")


def cast(v: Column, source: str, target: str, ndim: int) -> Column:
    """Any of the six kinds as any other; the same kind is left alone. f64 is array<double>, f32, f16 and bf16 are array<float>, i8 array<tinyint>, b1 64-bit words."""
    if source not in KINDS or target not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    if source == target:
        return v
    x = from_i8(v) if source == "i8" else from_bits(v, ndim) if source == "b1" else v
    to = {"f64": lambda: x.cast("array<double>"), "f32": lambda: x.cast("array<float>"), "f16": lambda: to_f16(x.cast("array<float>")), "bf16": lambda: to_bf16(x.cast("array<float>")), "i8": lambda: to_i8(x), "b1": lambda: to_bits(x)}
    return to[target]()
