"""Vector search over nodes (node_id, embedding), and searches that mix it with the graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.errors import DimensionMismatch, NoEmbedding
from graphspark.functions.distance import METRICS, distance, vector
from graphspark.graph import PropertyGraph
from graphspark.operators.traverse import arcs, bfs, neighbors
from graphspark.session import cut

#: Queries of a k-NN join that are held by a task at a time.
QUERY_BLOCK = 4_096


def knn(nodes: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(node_id, distance) of the k nearest, exactly: each task keeps its k best (TakeOrderedAndProject)."""
    d = distance(metric, F.col("embedding"), vector(query))
    return nodes.where(F.col("embedding").isNotNull()).select("node_id", d.alias("distance")).orderBy("distance", "node_id").limit(k)


def _distances(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return -(q @ c.T)
    if metric == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T), 0))
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 0, 1 - np.clip(q @ c.T / size, -1, 1), 1.0)


def knn_join(queries: DataFrame, nodes: DataFrame, k: int = 10, metric: str = "cosine", leave_self: bool = True) -> DataFrame:
    """(query_id, rank, node_id, distance) for every row of queries (node_id, embedding) against all nodes.

    Queries go out in blocks of QUERY_BLOCK vectors; each task compares a block with its rows by matrix products and
    returns its k best a query, so that only those are shuffled. One pass over the nodes for each block.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = nodes.sparkSession
    rows = nodes.where(F.col("embedding").isNotNull()).select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("node_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("distance", pa.float64())])
    parts, block = [], []

    def search(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                mine = b.column(0).to_numpy()
                c = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                d = _distances(metric, q, c)
                if leave_self:
                    d[ids[:, None] == mine[None, :]] = np.inf
                n = min(k, len(mine))
                cut_at = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                i, j = np.nonzero((d <= cut_at + 1e-12) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(mine[j]), pa.array(d[i, j])], schema=schema)

        return rows.mapInArrow(run, "query_id long, node_id long, distance double")

    for r in asked.toLocalIterator():
        block.append((r["node_id"], r["embedding"]))
        if len(block) == QUERY_BLOCK:
            parts.append(search(block))
            block = []
    if block:
        parts.append(search(block))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, node_id long, distance double")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "distance")


class InvertedIndex:
    """Approximate search in k-means cells: rows are kept by cell, and a query looks through the nearest cells only.

    Centres come from a bounded sample. How many cells a query looks through is measured: a bounded sample of rows is
    answered by brute force, and the fewest cells are taken that hold `recall` of the true neighbours. Snapshots are
    immutable: `insert`, `remove` and `rebuilt` give new ones; `rebuilt` draws the centres anew when rows have moved away
    from them. `save` writes the rows partitioned by cell, so that a search after `load` reads the files of its cells alone.
    """

    def __init__(self, rows: DataFrame, centers: np.ndarray, metric: str, probes: int):
        self.rows, self.centers, self.metric, self.probes = rows, centers, metric, probes

    @classmethod
    def build(cls, nodes: DataFrame, cells: int = 64, sample: int = 20_000, seed: int = 0, metric: str = "cosine", recall: float = 0.95, audit: int = 128, k: int = 10) -> "InvertedIndex":
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        rows = nodes.where(F.col("embedding").isNotNull()).select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
        got = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sample).collect()])
        if not len(got):
            return cls(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)), metric, 1)
        points = got / np.maximum(np.sqrt((got * got).sum(1, keepdims=True)), 1e-30) if metric == "cosine" else got
        rng = np.random.default_rng(seed)
        centers = points[rng.permutation(len(points))[:cells]].copy()
        for _ in range(10):
            mine = _cell_order(centers, points, metric)[:, 0]
            for c in np.unique(mine):
                centers[c] = points[mine == c].mean(0)
        index = cls(cut(cls._placed(rows, centers, metric)), centers, metric, len(centers))
        asked = index.rows.orderBy(F.xxhash64("node_id", F.lit(seed + 1)), "node_id").limit(audit)
        truth = knn_join(asked, index.rows, k, metric).join(index.rows.select("node_id", "cell"), "node_id").join(asked.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").select("q", "cell").collect()  # audit x k rows
        if truth:
            order = _cell_order(centers, np.array([r["q"] for r in truth]), metric)
            place = np.sort((order == np.array([r["cell"] for r in truth])[:, None]).argmax(1))
            index.probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1
        return index

    @staticmethod
    def _placed(rows: DataFrame, centers: np.ndarray, metric: str) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_cell_order(centers, x, metric)[:, 0].astype(np.int32))], names=["node_id", "embedding", "cell"])

        return rows.mapInArrow(place, "node_id long, embedding array<double>, cell int")

    def insert(self, nodes: DataFrame) -> "InvertedIndex":
        """With more rows (node_id, embedding); an id that is there already gets its new vector."""
        new = nodes.where(F.col("embedding").isNotNull()).select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
        odd = new.where(F.size("embedding") != self.centers.shape[1]).first()
        if odd is not None:
            raise DimensionMismatch(f"{len(odd['embedding'])} instead of {self.centers.shape[1]}")
        new = cut(self._placed(new, self.centers, self.metric))
        return InvertedIndex(self.rows.join(new.select("node_id"), "node_id", "left_anti").unionByName(new), self.centers, self.metric, self.probes)

    def remove(self, ids: DataFrame) -> "InvertedIndex":
        """Without these ids (node_id); ids that aren't there are no error."""
        return InvertedIndex(self.rows.join(ids.select("node_id").distinct(), "node_id", "left_anti"), self.centers, self.metric, self.probes)

    def rebuilt(self, **how) -> "InvertedIndex":
        return InvertedIndex.build(self.rows, **{"cells": len(self.centers), "metric": self.metric} | how)

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist(), self.metric, self.probes) for i, c in enumerate(self.centers)], "cell int, center array<double>, metric string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "InvertedIndex":
        centers = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # one row for each cell
        rows = spark.read.schema("node_id long, embedding array<double>, cell int").parquet(f"{path}/rows")
        return cls(rows, np.array([r["center"] for r in centers]), centers[0]["metric"], centers[0]["probes"])

    def search(self, query: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """(node_id, distance) of the k nearest in the nearest `probes` cells, as many as were measured to be needed by default."""
        near = _cell_order(self.centers, np.asarray([query], float), self.metric)[0, : probes or self.probes]
        return knn(self.rows.where(F.col("cell").isin(*map(int, near))), query, k, self.metric)


def _cell_order(centers: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """For each row of x the cells, nearest first."""
    return np.argsort(_distances(metric, x, centers), axis=1, kind="stable")


def hybrid_search(g: PropertyGraph, anchor: int, query: Sequence[float], max_hops: int = 3, k: int = 10, alpha: float = 0.5, metric: str = "cosine") -> DataFrame:
    """(node_id, score): alpha * distance + (1 - alpha) * depth / (max_hops + 1) over nodes within max_hops, anchor left out.

    A node without an embedding counts as at distance 1; one of another length is left out.
    """
    near = bfs(g, anchor, max_hops).where(F.col("node_id") != anchor)
    rows = near.join(g.nodes.select("node_id", "embedding"), "node_id").where(F.col("embedding").isNull() | (F.size("embedding") == len(query)))
    d = F.when(F.col("embedding").isNull(), 1.0).otherwise(distance(metric, F.col("embedding"), vector(query)))
    score = alpha * d + (1 - alpha) * F.col("depth") / (max_hops + 1)
    return rows.select("node_id", score.alias("score")).orderBy("score", "node_id").limit(k)


def semantic_neighbors(g: PropertyGraph, node: int, query: Sequence[float], k: int = 10, direction: str = "outgoing", metric: str = "cosine") -> DataFrame:
    """(node_id, distance) of the nearest neighbours with an embedding; parallel edges repeat."""
    rows = neighbors(g, node, direction).select("node_id").join(g.nodes.where(F.col("embedding").isNotNull()).select("node_id", "embedding"), "node_id")
    return rows.select("node_id", distance(metric, F.col("embedding"), vector(query)).alias("distance")).orderBy("distance", "node_id").limit(k)


def semantic_walk(g: PropertyGraph, start: int, query: Sequence[float], max_hops: int = 3, metric: str = "cosine") -> list[tuple[int, float]]:
    """(node_id, distance) of a greedy walk to the nearest unvisited outgoing neighbour; the start only with an embedding.

    What it needs lies within max_hops of the start; each step is one small top-1 query over the arcs.
    """
    vectors = g.nodes.where(F.col("embedding").isNotNull()).select("node_id", distance(metric, F.col("embedding"), vector(query)).alias("distance"))
    hops = arcs(g.edges).select("u", "v")
    first = vectors.where(F.col("node_id") == start).first()
    out, seen, here = [(start, first["distance"])] if first else [], {start}, start
    for _ in range(max_hops):
        row = hops.where((F.col("u") == here) & ~F.col("v").isin(*seen)).join(vectors, F.col("v") == F.col("node_id")).select("node_id", "distance").orderBy("distance", "node_id").first()
        if row is None:
            break
        here = row["node_id"]
        seen.add(here)
        out.append((here, row["distance"]))
    return out


def embedding_of(g: PropertyGraph, node: int) -> list[float]:
    row = g.nodes.where((F.col("node_id") == node) & F.col("embedding").isNotNull()).select("embedding").first()
    if row is None:
        raise NoEmbedding(str(node))
    return list(row["embedding"])
