"""Sparse linear algebra over edge frames, and message passing on arrays of features.

A row of features stays one array all the way: arrays are added up within each Arrow batch before the shuffle, and again
as the sorted rows of a key stream past after it, so neither the shuffle nor memory grows with the edges at a hub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.operators.ranking import global_rank
from graphspark.session import shuffle_width


def csr_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, col, value): edges within the node set with nodes numbered from 0 by node_id."""
    index = global_rank(nodes.select("node_id").distinct(), [F.col("node_id")], "i").select("node_id", (F.col("i") - 1).alias("i"))
    rows, cols = index.select(F.col("node_id").alias("src"), F.col("i").alias("row")), index.select(F.col("node_id").alias("dst"), F.col("i").alias("col"))
    return edges.join(rows, "src").join(cols, "dst").select("row", "col", F.col("weight").alias("value"))


def spmv(entries: DataFrame, x: DataFrame) -> DataFrame:
    """y = A x: (row, value) from (row, col, value) and (i, value); rows without entries are left out."""
    v = x.select(F.col("i").alias("col"), F.col("value").alias("x"))
    return entries.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def nnz(entries: DataFrame) -> int:
    return entries.count()


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) counting edges within the node set."""
    ids = nodes.select("node_id").distinct()
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    degree = inside.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return ids.join(degree, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Edges in both directions as (u, v, w); a self-loop once."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w")).union(edges.where("src <> dst").select("dst", "src", "weight"))


AGGREGATES = ("sum", "mean", "max")


def reduced(rows: DataFrame, key: str, how: str = "sum") -> DataFrame:
    """(key, features): the sum, mean or maximum of w * features of the rows (key, w, features) of each key."""
    if how not in AGGREGATES:
        raise ValueError(f"aggregate must be one of {AGGREGATES}")
    op = np.maximum if how == "max" else np.add
    schema = pa.schema([("key", pa.int64()), ("features", pa.list_(pa.float64())), ("n", pa.int64())])

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = b.column(1)
        return b.column(0).to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), b.column(2).to_numpy()

    def fold(k: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(k, kind="stable")
        k, x, n = k[order], x[order], n[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return k[at], op.reduceat(x, at, axis=0), np.add.reduceat(n, at)

    def batch(k: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(k), values, pa.array(n)], schema=schema)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, x, w = columns(b)
                yield batch(*fold(k, x * w[:, None], np.ones(len(k), np.int64)))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                now = columns(b)
                k, x, n = fold(*(np.concatenate(c) for c in zip(held, now, strict=True)) if held else now)
                held = k[-1:], x[-1:], n[-1:]
                if len(k) > 1:
                    yield batch(k[:-1], x[:-1], n[:-1])
        if held:
            yield batch(*held)

    kind = "key long, features array<double>, n long"
    parts = rows.select(F.col(key).cast("long"), F.col("features").cast("array<double>"), F.col("w").cast("double")).mapInArrow(before, kind)
    out = parts.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(after, kind)
    values = F.transform("features", lambda x: x / F.col("n")) if how == "mean" else F.col("features")
    return out.select(F.col("key").alias(key), values.alias("features"))


def spmm(entries: DataFrame, dense: DataFrame) -> DataFrame:
    """C = A B: (row, features) from (row, col, value) and (i, features)."""
    b = dense.select(F.col("i").alias("col"), "features")
    return reduced(entries.join(b, "col").select("row", F.col("value").alias("w"), "features"), "row")


#: Activations as rules on a column.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "tanh": F.tanh,
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
}


def message_passing(features: DataFrame, edges: DataFrame, aggregate: str = "mean", activation: str = "none", normalize: bool = False) -> DataFrame:
    """(node_id, features): each node takes the aggregate of weight * features of its neighbours, both directions.

    A node without messages keeps its features as they are, neither activated nor normalised.
    """
    f = features.select("node_id", F.col("features").cast("array<double>").alias("features"))
    new = _messages(f, edges, aggregate)
    act = F.transform("features", ACTIVATIONS[activation])
    if normalize:
        size = F.sqrt(F.aggregate(act, F.lit(0.0), lambda s, x: s + x * x))
        act = F.when(size > 1e-12, F.transform(act, lambda x: x / size)).otherwise(act)
    return f.join(new.select("node_id", act.alias("new")), "node_id", "left").select("node_id", F.coalesce("new", "features").alias("features"))


def _messages(features: DataFrame, edges: DataFrame, aggregate: str) -> DataFrame:
    sent = symmetrized(edges).join(features.select(F.col("node_id").alias("v"), "features"), "v")
    return reduced(sent.select("u", "w", "features"), "u", aggregate).withColumnRenamed("u", "node_id")


def weighted_message_passing(features: DataFrame, edges: DataFrame, neighbor: np.ndarray, own: np.ndarray, bias: np.ndarray, aggregate: str = "mean", activation: str = "none") -> DataFrame:
    """(node_id, features): act(aggregate of weight * neighbours' features @ neighbor + own features @ own + bias).

    A node without messages has an aggregate of zeros. The weights are small matrices, sent with the function.
    """
    f = features.select("node_id", F.col("features").cast("array<double>").alias("features"))
    near = f.join(_messages(f, edges, aggregate).withColumnRenamed("features", "near"), "node_id", "left")
    schema = pa.schema([("node_id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                a, met = np.zeros_like(x), b.column(2).is_valid().to_numpy(zero_copy_only=False)
                a[met] = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(met.sum(), -1)
                z = a @ neighbor + x @ own + bias
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), values], schema=schema)

    out = near.select("node_id", "features", "near").mapInArrow(run, "node_id long, features array<double>")
    return out.select("node_id", F.transform("features", ACTIVATIONS[activation]).alias("features"))
