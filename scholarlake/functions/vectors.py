"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; null for a zero vector, which has no direction."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def checked(v: Column, size: int) -> Column:
    """``v``, or an error where its dimension differs; null stays null."""
    return F.when(v.isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {size}: "), F.size(v).cast("string"))))
