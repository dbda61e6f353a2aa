"""Connected components by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.joins import spread_join
from graphspark.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Rows with a null end or equal ends are ignored. Each round contracts towards the smallest neighbour from both sides,
    so a component of any shape needs about log(size) rounds; it is an error if `max_rounds` don't settle it. Minima are
    pre-aggregated before the shuffle, and the rows of hubs stay where they are in joins.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = cut(pairs.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = spread_join(both.where(F.col("v") > F.col("u")), smallest, ["u"], "n", mark[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select(F.col("b"), F.col("b").alias("c")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 32)))).first()
    return tuple(row)
