"""Column expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-12


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column, clip: bool = True) -> Column:
    """Cosine similarity; 0 for a zero vector, limited to [0, 1] unless clip is off."""
    na, nb = norm(a), norm(b)
    raw = F.try_divide(inner_product(a, b), na * nb)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if clip else raw
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), F.lit(0.0)).otherwise(value)


def pseudo_similarity(sq_distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + sq_distance)


def _let(value: Column, body) -> Column:
    """body(value) with `value` computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    bound = F.struct(as_double(a).alias("v"), norm(a).alias("n"))
    return _let(bound, lambda s: F.when(s["n"] < ZERO_NORM, s["v"]).otherwise(
        F.transform(s["v"], lambda x: F.try_divide(x, s["n"]))))


def finite(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def minmax_vector(a: Column) -> Column:
    """NaN, infinity and NULL become 0, then the vector is scaled to [0, 1] unless it is flat."""
    def scaled(s: Column) -> Column:
        return F.when(
            s["hi"] - s["lo"] > 1e-12, F.transform(s["v"], lambda x: F.try_divide(x - s["lo"], s["hi"] - s["lo"]))
        ).otherwise(s["v"])

    clean = F.transform(as_double(a), finite)
    bounds = lambda v: F.struct(v.alias("v"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return _let(_let(clean, bounds), scaled)


def pad_to(a: Column, size: int) -> Column:
    """Append zeros up to `size` elements."""
    missing = F.greatest(F.lit(0), F.lit(size) - F.size(a))
    return F.concat(as_double(a), F.array_repeat(F.lit(0.0), missing))
