"""Arithmetic on array columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Bind a value once for use inside a lambda, which would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(vector: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    return let(vector, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; 0 when one of them is zero."""
    a, b = as_double(a), as_double(b)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
