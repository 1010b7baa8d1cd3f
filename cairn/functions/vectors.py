"""Vector functions over arrays, in double precision."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length to speak of."""
    return F.when((norm(a) < 1e-10) | (norm(b) < 1e-10), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def info_nce(energies: Column) -> Column:
    """-log of the softmax of the negated energies at the first place."""
    least = F.array_min(energies)
    return energies[0] - least + F.log(total(F.transform(energies, lambda e: F.exp(least - e))))


def mean_pool(rows: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1."""
    n = F.greatest(total(mask.cast("array<double>")), F.lit(1.0))
    picked = F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda v: v.cast("double") * m))
    zero = F.transform(rows[0], lambda v: F.lit(0.0))
    return F.transform(F.aggregate(picked, zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y)), lambda v: v / n)
