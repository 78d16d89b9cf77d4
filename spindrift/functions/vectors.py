"""Vector algebra on ARRAY columns, in double precision and inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the dimensions differ, so that mismatched rows can be skipped."""
    norm = magnitude(a) * magnitude(b)
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def dot_constant(a: Column, query: list[float]) -> Column:
    """Dot product with a fixed vector as one flat expression, which whole-stage code generation compiles."""
    return reduce(lambda s, x: s + x, (a[i].cast("double") * F.lit(float(q)) for i, q in enumerate(query)), F.lit(0.0))


def cosine_constant(a: Column, query: list[float]) -> Column:
    size = sum(q * q for q in query) ** 0.5
    own = F.sqrt(reduce(lambda s, x: s + x, (a[i].cast("double") * a[i].cast("double") for i in range(len(query))), F.lit(0.0)))
    return F.when(F.size(a) == len(query), F.when((own == 0) | F.lit(size == 0), F.lit(0.0)).otherwise(dot_constant(a, query) / (own * F.lit(size))))


def euclidean(a: Column, b: Column) -> Column:
    """Infinity where the dimensions differ."""
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def normalize(a: Column) -> Column:
    n = magnitude(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def every(a: Column, ratio: float) -> Column:
    """Strided reduction: every floor(d / keep)-th coordinate, keep = max(1, floor(d (1 - ratio)))."""
    step = F.floor(F.size(a) / F.greatest(F.lit(1), F.floor(F.size(a) * (1 - ratio))))
    return F.filter(a, lambda x, i: i % step == 0)


def bucket(similarity: Column) -> Column:
    """Millionths, half up: the key that scores are ordered and tied by."""
    return F.floor(similarity * 1e6 + 0.5)
