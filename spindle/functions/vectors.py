"""Dense-vector arithmetic on ARRAY<DOUBLE> columns (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector divided by its length (taken once); NULL when that is zero."""
    return F.when(norm(a) > 0, F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x / n))
