"""Column functions on arrays of floats; all arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """To length one; a zero vector stays as it is."""
    n = F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0))
    return F.transform(doubles(v), lambda x: x / n)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, from differences, so that close vectors don't cancel."""
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
