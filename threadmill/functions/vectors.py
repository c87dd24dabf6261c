"""Vector functions in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null or has no length, never NaN."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1, so that a plain ``dot`` of two is their cosine; null if it has no length."""
    length = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.when(length.isNotNull(), F.transform(a, lambda x: x.cast("double") / length))
