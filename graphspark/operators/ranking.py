"""Global positions without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.session import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a long column: the row's place from 1 in the total order `order`.

    Rows are dealt by ranges and sorted within them; the result is written once, so that the ranges stay as they are, and
    each range then adds the count of those before it (one number for each range, so a bounded broadcast). Columns that
    begin with `__` are taken.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", 33).cast("int")
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).orderBy("__part").collect()  # one row for each range
    before, total = {}, 0
    for row in sizes:
        before[row["__part"]] = total
        total += row["__n"]
    if not before:
        return placed.select(*df.columns, F.lit(1).cast("long").alias(name))
    offsets = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    place = offsets[part] + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(*df.columns, place.cast("long").alias(name))
