"""Vector functions over ``array<double>`` as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.greatest(norm(a), F.lit(FLOOR)), F.size(a)).alias("n")), lambda t: t["x"] / t["n"])


def clamp(score: Column) -> Column:
    """Into [0, 1]; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def unit_score(cosine: Column) -> Column:
    return clamp((1 + cosine) / 2)


def is_valid(vector: Column, dim: int) -> Column:
    """Right length, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
