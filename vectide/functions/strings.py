"""Edit distances on text, by bytes or code points; a positive bound caps the result, bound 0 doesn't, a negative one raises."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of a batch that are compared at once.
STEP = 1024


def _capped(d: Column, bound: int) -> Column:
    if bound < 0:
        raise ValueError("the bound must not be negative")
    return F.least(d, F.lit(bound)) if bound else d


def _as_bytes(s: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def levenshtein_unicode(a: Column, b: Column, bound: int = 0) -> Column:
    return _capped(F.levenshtein(a, b), bound)


def levenshtein_bytes(a: Column, b: Column, bound: int = 0) -> Column:
    return levenshtein_unicode(_as_bytes(a), _as_bytes(b), bound)


def _units(s: pa.Array, by_bytes: bool) -> tuple[np.ndarray, np.ndarray]:
    """All bytes or code points of an array of strings, and where each string starts and ends in them."""
    s = s.cast(pa.large_string())
    ends, data = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1], s.buffers()[2]
    whole = (data.to_pybytes() if data is not None else b"")[ends[0] : ends[-1]]
    if by_bytes or whole.isascii():
        return np.frombuffer(whole, np.uint8), ends - ends[0]
    sizes = pc.utf8_length(s).to_numpy(zero_copy_only=False)
    return np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _differing(by_bytes: bool):
    """Of two arrays of strings: differing positions of the common length, plus the difference of the lengths; STEP rows at once."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        valid, out = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False), np.zeros(len(a), dtype=np.int32)
        for i in range(0, len(a), STEP):
            (x, at), (y, to) = (_units(c[i : i + STEP].fill_null(""), by_bytes) for c in (a, b))
            n = np.minimum(np.diff(at), np.diff(to))
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            out[i : i + STEP] = np.bincount(row[x[at[row] + place] != y[to[row] + place]], minlength=len(n)) + np.abs(np.diff(at) - np.diff(to))
        return pa.array(out, pa.int32(), mask=~valid)

    return run


def hamming_unicode(a: Column, b: Column, bound: int = 0) -> Column:
    """Differing positions of the common length, plus the difference of the lengths."""
    return _capped(F.arrow_udf(_differing(False), "int")(a, b), bound)


def hamming_bytes(a: Column, b: Column, bound: int = 0) -> Column:
    return _capped(F.arrow_udf(_differing(True), "int")(a, b), bound)
