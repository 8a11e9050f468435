"""SQL functions by name: distance_<metric>_<kind> and the text distances.

Arguments are two binary vectors of the kind, two JSON (or comma-separated) texts, or 2n numbers, the first half against
the second; a null number is 0, a null vector gives null. Texts and numbers are read as doubles by the f64 functions
and as floats by all others. Vectors of different lengths raise, as does divergence of 8-bit binary vectors; the cosine
distance of those is 0 where their product is."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vectide.functions.metrics import EPSILON

SCALARS = {"f64": np.float64, "f32": np.float32, "f16": np.float16, "i8": np.int8}


def _cosine(a, b, i8=False):
    ab, aa, bb = (a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1)
    scale = np.sqrt(aa) * np.sqrt(bb)
    out = np.where(scale > 0, 1 - ab / np.where(scale > 0, scale, 1), np.where((aa == 0) & (bb == 0), 0.0, 1.0))
    return np.where(ab == 0, 0.0, out) if i8 else out


def _divergence(p, q):
    m = (p + q) / 2 + EPSILON
    return (p * np.log((p + EPSILON) / m) + q * np.log((q + EPSILON) / m)).sum(axis=1) / 2


def _haversine(a, b):
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[:, 0] - a[:, 0]) / 2) ** 2 + np.cos(a[:, 0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[:, 1]) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


#: rows x dimensions against rows x dimensions.
DENSE = {"sqeuclidean": lambda a, b: ((a - b) ** 2).sum(axis=1), "cosine": _cosine, "inner": lambda a, b: 1 - (a * b).sum(axis=1), "divergence": _divergence}


def _number(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind) or pa.types.is_null(kind)


def _parsed(text: str) -> list[float]:
    text = text.strip()
    return json.loads(text if text.startswith("[") else f"[{text}]")


def _dense(name: str, f, scalar):
    read = np.float64 if scalar is np.float64 else np.float32

    def rows(values: list, as_bytes: bool) -> np.ndarray:
        """Vectors of one length as a matrix."""
        if as_bytes:
            return np.frombuffer(b"".join(values), dtype=scalar).reshape(len(values), -1).astype(np.float64)
        return np.array(values, dtype=read).astype(np.float64).reshape(len(values), -1)

    def pairs(a: pa.Array, b: pa.Array) -> pa.Array:
        as_bytes = pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type)
        if as_bytes and scalar is np.int8 and name == "divergence":
            raise ValueError("divergence isn't defined for binary i8 vectors")
        here = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
        x, y = (c.take(pa.array(here)).to_pylist() for c in (a, b))
        x, y = (v if as_bytes else [_parsed(t) for t in v] for v in (x, y))
        groups: dict[int, list[int]] = {}
        for i, (u, v) in enumerate(zip(x, y, strict=True)):
            if len(u) != len(v):
                raise ValueError("vectors have different numbers of dimensions")
            groups.setdefault(len(u), []).append(i)
        out = np.full(len(a), np.nan)
        for at in groups.values():
            u, v = rows([x[i] for i in at], as_bytes), rows([y[i] for i in at], as_bytes)
            out[here[at]] = f(u, v, True) if as_bytes and scalar is np.int8 and name == "cosine" else f(u, v)
        missing = np.ones(len(a), dtype=bool)
        missing[here] = False
        return pa.array(out, pa.float64(), mask=missing)

    def run(*cols: pa.Array) -> pa.Array:
        if len(cols) == 2 and not any(_number(c.type) for c in cols):
            if cols[0].type != cols[1].type:
                raise ValueError("vectors must be both binary or both text")
            return pairs(*cols)
        if len(cols) % 2:
            raise ValueError("an even number of columns is needed")
        if not all(_number(c.type) for c in cols):
            raise ValueError("columns of vectors must be numbers")
        x = np.stack([c.cast(pa.float64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False).astype(read).astype(np.float64) for c in cols], axis=1)
        return pa.array(f(x[:, : len(cols) // 2], x[:, len(cols) // 2 :]), pa.float64())

    return run


def _bits(f):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            out.append(None if x is None or y is None else float(f(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))))
        return pa.array(out, pa.float64())

    return run


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; their names."""
    names = []

    def put(name, f):
        spark.udf.register(name, F.arrow_udf(f, "double"))
        names.append(name)

    for m, f in DENSE.items():
        for kind, scalar in SCALARS.items():
            put(f"distance_{m}_{kind}", _dense(m, f, scalar))
    put("distance_haversine_meters", _dense("haversine", lambda a, b: _haversine(a, b) * 6371008.8, np.float64))
    put("distance_hamming_binary", _bits(lambda x, y: np.bitwise_count(x ^ y).sum()))
    put("distance_jaccard_binary", _bits(lambda x, y: 1 - np.bitwise_count(x & y).sum() / max(1, np.bitwise_count(x | y).sum())))
    latin = "decode(encode({}, 'UTF-8'), 'ISO-8859-1')"
    for unit, a, b in (("bytes", latin.format("a"), latin.format("b")), ("unicode", "a", "b")):
        d = {
            "levenshtein": f"levenshtein({a}, {b})",
            "hamming": f"aggregate(sequence(1, greatest(1, least(length({a}), length({b})))), 0, (s, i) -> s + if(substr({a}, i, 1) <> substr({b}, i, 1) and i <= least(length({a}), length({b})), 1, 0)) + abs(length({a}) - length({b}))",
        }
        for kind, body in d.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION distance_{kind}_{unit}(a STRING, b STRING, bound INT DEFAULT 0) RETURNS INT RETURN if(bound < 0, raise_error('the bound must not be negative'), if(bound > 0, least({body}, bound), {body}))")
            names.append(f"distance_{kind}_{unit}")
    return names
