"""Vectors as arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.protein import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null for a null vector or one of length zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2(a: str | Column, b: str | Column) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: str | Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


def lerp(a: str | Column, b: str | Column, alpha: Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (1 - alpha) * x.cast("double") + alpha * y.cast("double"))


def mean_of(vectors: str | Column) -> Column:
    """Mean of an array of vectors (mean pooling); null if there is none."""
    v = col(vectors)
    total = F.aggregate(v, F.transform(F.get(v, F.lit(0)), lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q.cast("double")))
    return F.when(F.size(v) > 0, F.transform(total, lambda x: x / F.size(v)))
