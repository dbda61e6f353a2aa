"""Joins on keys of which a few hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a join keeps apart at most.
HOT_KEYS = 1_024


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with `lookup`, which has one row for each key and in `weight` how many of the `total` rows have that key.

    Fewer than HOT_KEYS keys can have more than the HOT_KEYS-th part of the rows each: these are broadcast, so their rows
    stay where they are; all other keys are small and are shuffled.
    """
    many = F.col(weight) > max(1, total // HOT_KEYS)
    hot, cold = F.broadcast(lookup.where(many).drop(weight)), lookup.where(~many).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
