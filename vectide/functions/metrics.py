"""Distances as Column expressions over arrays; sums are in double. A null vector gives a null distance.

Fixed corner cases: cos is 0 for two zero vectors and 1 for one (on 8-bit vectors it is 0 whenever the dot product
is 0); pearson is 0 without variance; tanimoto and sorensen of two empty bit sets are NaN; haversine takes degrees
and returns radians; divergence adds the machine epsilon of float inside its logarithms' ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.0**-23


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column, b: Column, f: Callable) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), f), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def ip(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def cos(a: Column, b: Column) -> Column:
    ab, aa, bb = dot(a, b), dot(a, a), dot(b, b)
    return F.when((aa == 0) & (bb == 0), 0.0).when((aa == 0) | (bb == 0), 1.0).otherwise(1 - ab / F.nullif(F.sqrt(aa) * F.sqrt(bb), F.lit(0.0)))


def cos_i8(a: Column, b: Column) -> Column:
    ab = dot(a, b)
    return F.when(ab == 0, 0.0).otherwise(1 - ab / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double")
    one = lambda v: F.aggregate(_double(v), F.lit(0.0), lambda acc, x: acc + x)
    sa, sb = one(a), one(b)
    spread = (n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)
    return F.when((n <= 1) | (spread <= 0), F.when(a.isNotNull() & b.isNotNull(), 0.0)).otherwise(1 - (n * dot(a, b) - sa * sb) / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0)))


def divergence(a: Column, b: Column) -> Column:
    def term(p, q):
        m = (p + q) / 2 + EPSILON
        return p * F.ln((p + EPSILON) / m) + q * F.ln((q + EPSILON) / m)

    return _sum(a, b, term) / 2


def haversine(a: Column, b: Column) -> Column:
    at = lambda v, i: F.radians(F.element_at(_double(v), i))
    dlat, dlon = (at(b, i) - at(a, i) for i in (1, 2))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(at(a, 1)) * F.cos(at(b, 1)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def haversine_meters(a: Column, b: Column) -> Column:
    """haversine on a sphere of the Earth's mean radius."""
    return haversine(a, b) * 6371008.8


def _bits(a: Column, b: Column, f: Callable) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)


def hamming(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y)).cast("double")


def tanimoto(a: Column, b: Column) -> Column:
    both, either = _bits(a, b, lambda x, y: x.bitwiseAND(y)), _bits(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(either == 0, F.lit(float("nan"))).otherwise(1 - both / F.nullif(either, F.lit(0).cast("long")))


def sorensen(a: Column, b: Column) -> Column:
    both, total = _bits(a, b, lambda x, y: x.bitwiseAND(y)), _bits(a, a, lambda x, y: x) + _bits(b, b, lambda x, y: x)
    return F.when(total == 0, F.lit(float("nan"))).otherwise(1 - 2 * both / F.nullif(total, F.lit(0).cast("long")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; repeated members count once."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(float("nan"))).otherwise(1 - F.size(F.array_intersect(a, b)) / F.nullif(either, F.lit(0)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "ip": ip, "cos": cos, "cos_i8": cos_i8, "l2sq": l2sq, "pearson": pearson, "divergence": divergence, "haversine": haversine,
    "hamming": hamming, "tanimoto": tanimoto, "sorensen": sorensen, "jaccard": jaccard,
}
ALIASES = {"cosine": "cos", "angular": "cos", "dot": "ip", "inner": "ip", "inner_product": "ip", "l2_sq": "l2sq", "euclidean_sq": "l2sq", "sqeuclidean": "l2sq", "tanimoto_bits": "tanimoto"}


def metric(name: str | Callable) -> Callable[[Column, Column], Column]:
    """The expression builder of a name; a callable (Column, Column) -> Column is a metric of one's own."""
    if callable(name):
        return name
    try:
        return METRICS[ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"Unsupported metric: {name}") from None
