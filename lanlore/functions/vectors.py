"""Arithmetic on array<double> columns with higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def array_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def scale(vector: Column, means: Column, stds: Column) -> Column:
    """Centre and divide by the standard deviation; a constant feature becomes 0."""
    centred = F.zip_with(vector, means, lambda x, m: x - m)
    return F.zip_with(centred, stds, lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of the members of array<array<double>> (all of one length)."""
    n = F.size(vectors)
    first = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)
