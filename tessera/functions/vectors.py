"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor under a norm before division.
NORM_FLOOR = 1e-12


def bound(value: Column, body) -> Column:
    """``body`` of a value computed once; what a lambda takes from outside is else computed at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    return bound(as_doubles(v), lambda d: bound(F.greatest(norm(d), F.lit(NORM_FLOOR)), lambda n: F.transform(d, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def array_mean(v: Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def standardized(v: Column) -> Column:
    """Zero mean and unit population variance, with a floor under the variance."""
    variance = lambda d, m: F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(d)
    scaled = lambda d, m: bound(F.sqrt(variance(d, m) + F.lit(1e-7)), lambda r: F.transform(d, lambda x: (x - m) / r))
    return bound(as_doubles(v), lambda d: F.when(F.size(d) > 0, bound(array_mean(d), lambda m: scaled(d, m))).otherwise(d))


def chunk_means(seq: Column, size: int) -> Column:
    """Means of consecutive groups of ``size`` vectors of an array of vectors; the last group may be shorter."""
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(seq) / size).cast("int") - 1), lambda i: F.slice(seq, i * size + 1, size))

    def mean(g: Column) -> Column:
        total = F.aggregate(F.slice(g, 2, F.size(g)), as_doubles(F.element_at(g, 1)), lambda s, v: F.zip_with(s, as_doubles(v), lambda x, y: x + y))
        return F.transform(total, lambda x: x / F.size(g))

    return F.when(F.size(seq) > 0, F.transform(groups, mean)).otherwise(F.array().cast("array<array<double>>"))


def at_quantile(ascending: Column, q: float) -> Column:
    """Quantile of an ascending array with linear interpolation."""
    spot = F.lit(q) * (F.size(ascending) - 1)
    low = F.floor(spot).cast("int")
    a = F.element_at(ascending, low + 1)
    b = F.element_at(ascending, F.least(low + 2, F.size(ascending)))
    return F.when(F.size(ascending) > 0, a + (b - a) * (spot - low))
