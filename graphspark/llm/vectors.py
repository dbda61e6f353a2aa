"""What the vector operators share: usable vectors, classes of equal vectors, and packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, d, v array<double>, h1, h2) of the vectors that take part: not null, not empty, not zero, all components finite.

    d is the dimension; h1 and h2 name the vector's value; -0.0 counts as 0.0. Rows that repeat a vec_id with an equal
    vector count once.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.size("v").alias("d"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"])


def dimensions(rows: DataFrame) -> list[int]:
    """The dimensions that occur in what `usable` gives; vectors of different dimensions have nothing to do with each other."""
    return sorted(r["d"] for r in rows.select("d").distinct().collect())


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def salt(ways: Column, key: str) -> Column:
    return F.pmod(F.xxhash64(key), ways).cast("int")
