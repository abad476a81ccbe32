"""Vectors: arrays of floats, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product over the shorter length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalize(v: str) -> Column:
    """Unit length; vectors that are zero or within 1e-6 of unit length stay as they are."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm == 0) | (F.abs(norm - 1) < 1e-6), F.col(v)).otherwise(F.transform(F.col(v), lambda x: (x / norm).cast("float")))
