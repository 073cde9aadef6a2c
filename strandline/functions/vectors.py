"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double precision; null if a length differs or an array is null."""
    a, b = col(a), col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector at length one; null for one of no length."""
    a = col(a)
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def is_unit(a: str | Column, tolerance: float = 1e-3) -> Column:
    """Whether every number is finite and the length is one."""
    a = col(a)
    return F.forall(a, lambda x: ~F.isnan(x) & x.isNotNull()) & (F.abs(norm(a) - 1) < tolerance)
