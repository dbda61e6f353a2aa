"""Shard numbers for nodes, where they must be the same as elsewhere; Spark's own partitioning needs none of this."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(ids: np.ndarray) -> np.ndarray:
    """FNV-1a over the eight little-endian bytes of each id."""
    data = np.ascontiguousarray(ids, dtype="<u8").view(np.uint8).reshape(-1, 8)
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    for k in range(8):
        h = (h ^ data[:, k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def hash_shard(node: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series((fnv1a(s.to_numpy(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32))

    return run(node)


def uniform_boundaries(top: int, shards: int) -> list[int]:
    """Upper ends of all shards but the last, for ids from 0 to top."""
    width = max(1, top // shards)
    return [width * (k + 1) for k in range(shards - 1)]


def range_shard(node: Column, boundaries: Sequence[int]) -> Column:
    """The first shard whose upper end is above the id; beyond all of them the last."""
    out = F.lit(len(boundaries))
    for k in range(len(boundaries) - 1, -1, -1):
        out = F.when(node < boundaries[k], k).otherwise(out)
    return out.cast("int")


def edge_shards(edges: DataFrame, shards: int) -> DataFrame:
    """Edges follow their source."""
    return edges.withColumn("shard", hash_shard(F.col("src"), shards))
