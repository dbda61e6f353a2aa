"""Vector distances as column expressions, in double precision; smaller is nearer for all three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine kept within [-1, 1]; a zero vector is at distance 1."""
    size = norm(a) * norm(b)
    c = dot(a, b) / F.when(size > 0, size)
    return F.when(size > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))).otherwise(1.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    """By name; vectors of different lengths are an error at run time."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    d = {"cosine": cosine, "euclidean": euclidean, "dot": dot_distance}[metric](a, b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(d)
