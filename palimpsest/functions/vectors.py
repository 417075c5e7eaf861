"""Vector arithmetic over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def clamp(c: Column) -> Column:
    """Into 0 to 1; null stays."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
