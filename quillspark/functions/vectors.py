"""Column helpers for vectors held as arrays; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; null where the lengths differ or a number is null."""
    sizes = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(sizes == 0, F.lit(0.0)).otherwise(dot(a, b) / sizes)
