"""Vectors as arrays, computed in double."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; null for a zero, empty or non-finite vector."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < F.lit(float("inf"))), F.transform(v, lambda x: x.cast("double") / norm))
