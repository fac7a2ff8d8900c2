"""Vector functions over array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(inner(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / F.nullif(F.sqrt(inner(a, a)) * F.sqrt(inner(b, b)), F.lit(0.0))
