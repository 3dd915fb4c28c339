"""Expressions over ARRAY<DOUBLE> columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    """Row scaled to unit length; a zero row stays zero."""
    norms = F.array_repeat(F.sqrt(dot(a, a)), F.size(a))  # inside a transform, the sum would run anew for every element
    return F.zip_with(a, norms, lambda x, norm: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    """0-based position of the first minimum."""
    return F.array_position(a, F.array_min(a)) - 1


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def array_sum(a: Column) -> Column:
    """Aggregate: element-wise sum of arrays, with a map-side partial buffer."""
    return vector_to_array(Summarizer.sum(array_to_vector(a)))


def array_mean(a: Column) -> Column:
    """Aggregate: element-wise mean of arrays."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))
