"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import as_column


def as_doubles(v: Column | str) -> Column:
    return as_column(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column | str) -> Column:
    """v at length 1; a zero vector stays."""
    v = as_doubles(v)
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
