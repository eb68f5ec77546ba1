"""Vector kernel on arrays of doubles, in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def mixed(q: Column, source: Column, weight: float = 0.65) -> Column:
    """The query's vector mixed with its source's, of unit length."""
    return normalized(F.zip_with(q, source, lambda x, y: x.cast("double") * weight + y.cast("double") * (1 - weight)))
