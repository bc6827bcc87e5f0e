"""Column functions that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def word_count(text: Column) -> Column:
    """Words parted by white space; null for null."""
    return F.regexp_count(text, F.lit(r"\S+"))


def sample_skewness(x: Column) -> Column:
    """Skewness with the adjustment for samples (Spark's is that of the population)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def json_int(text: Column, key: str) -> Column:
    """An integer member of a JSON object; null if there is none."""
    return F.get_json_object(text, f"$.{key}").cast("bigint")
