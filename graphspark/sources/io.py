"""Reading and writing graphs: frames, Arrow, JSON, and Parquet partitions by key. Paths go to Spark, so any store will do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.errors import GraphError
from graphspark.graph import DEFAULT_EDGE_TYPE, EDGES, NODES, PropertyGraph
from graphspark.operators.mutate import add_edges
from graphspark.operators.ranking import global_rank


def _numbered(df: DataFrame, key: str, start: int, order: Sequence[str]) -> DataFrame:
    """df with `key` where it is missing or 0, from start on in the order given."""
    unset = F.coalesce(F.col(key), F.lit(0)) == 0
    given = df.where(~unset)
    new = global_rank(df.where(unset).drop(key), [F.col(c) for c in order], "__n").withColumn(key, F.col("__n") + (start - 1)).drop("__n")
    return given.unionByName(new.select(*df.columns))


def _column(df: DataFrame, name: str, kind: str, default=None):
    return (F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)).alias(name)


def node_frame(df: DataFrame, start: int = 1) -> DataFrame:
    """Canonical nodes from columns labels (JSON text or array), properties (JSON text), and id (0 or missing: unset)."""
    labels = F.col("labels") if dict(df.dtypes)["labels"].startswith("array") else F.from_json("labels", "array<string>")
    key = F.col("id") if "id" in df.columns else F.col("node_id") if "node_id" in df.columns else F.lit(0)
    out = df.select(key.cast("long").alias("node_id"), labels.alias("labels"), F.coalesce(_column(df, "properties", "string"), F.lit("{}")).alias("properties"), _column(df, "embedding", "array<float>"))
    return _numbered(out, "node_id", start, ["labels", "properties"])


def edge_frame(df: DataFrame, start: int = 1) -> DataFrame:
    """Canonical edges from source, target, edge_type, properties, weight, and valid_from and valid_to if there."""
    a, b = ("source", "target") if "source" in df.columns else ("src", "dst")
    out = df.select(_column(df, "edge_id", "long", 0), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"), F.coalesce(_column(df, "edge_type", "string"), F.lit(DEFAULT_EDGE_TYPE)).alias("edge_type"), F.coalesce(_column(df, "properties", "string"), F.lit("{}")).alias("properties"), F.coalesce(_column(df, "weight", "double"), F.lit(1.0)).alias("weight"), _column(df, "valid_from", "long"), _column(df, "valid_to", "long"))
    return _numbered(out, "edge_id", start, ["src", "dst", "edge_type", "properties"])


def empty(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph.of(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def ingest(g: PropertyGraph, df: DataFrame | pa.Table) -> PropertyGraph:
    """Nodes if there is a labels column, edges if there is edge_type, else an error."""
    if isinstance(df, pa.Table):
        df = g.spark.createDataFrame(df.to_pandas())
    if "labels" in df.columns:
        start = (g.nodes.agg(F.max("node_id")).first()[0] or 0) + 1
        return g.plus(nodes=node_frame(df, start))
    if "edge_type" in df.columns:
        start = (g.edges.agg(F.max("edge_id")).first()[0] or 0) + 1
        return add_edges(g, edge_frame(df, start))
    raise GraphError("neither a labels nor an edge_type column")


def nodes_from_frame(df: DataFrame, label: str | None = None, label_col: str | None = None, id_col: str | None = None, embedding_cols: Sequence[str] = ()) -> DataFrame:
    """Canonical nodes from a flat frame: one label, embedding columns, and all other columns as properties."""
    labels = F.array(F.col(label_col)) if label_col else F.array(F.lit(label)) if label else F.array().cast("array<string>")
    rest = [c for c in df.columns if c not in {label_col, id_col, *embedding_cols}]
    out = df.select((F.col(id_col) if id_col else F.lit(0)).cast("long").alias("id"), labels.alias("labels"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("properties"), (F.array(*embedding_cols) if embedding_cols else F.lit(None)).cast("array<float>").alias("embedding"))
    return node_frame(out)


def edges_from_frame(df: DataFrame, source: str = "source", target: str = "target", edge_type: str | None = None, weight: str | None = None, valid_from: str | None = None, valid_to: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in {source, target, edge_type, weight, valid_from, valid_to}]
    pick = lambda c, kind, default=None: (F.col(c) if c else F.lit(default)).cast(kind)
    out = df.select(F.col(source).alias("source"), F.col(target).alias("target"), pick(edge_type, "string", DEFAULT_EDGE_TYPE).alias("edge_type"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("properties"), pick(weight, "double", 1.0).alias("weight"), pick(valid_from, "long").alias("valid_from"), pick(valid_to, "long").alias("valid_to"))
    return edge_frame(out)


# --- JSON

def read_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[PropertyGraph, int]:
    """A graph from a JSON array (with `lines`, one object a line) of {type: node or edge, ...}, and the number of rows of neither type."""
    schema = "type string, id long, labels array<string>, properties variant, embedding array<float>, source long, target long, edge_type string, weight double, valid_from long, valid_to long"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("properties", F.to_json("properties"))
    nodes = node_frame(rows.where("type = 'node'").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "properties", "embedding"))
    edges = edge_frame(rows.where("type = 'edge'").select("source", "target", "edge_type", "properties", "weight", "valid_from", "valid_to"))
    return PropertyGraph.of(nodes, edges), rows.where("type is null or type not in ('node', 'edge')").count()


def write_json(g: PropertyGraph, path: str) -> None:
    """One JSON object a line, nodes and edges in folders of their own."""
    props = F.try_parse_json("properties").alias("properties")
    g.nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), "labels", props, "embedding").write.mode("overwrite").json(f"{path}/nodes")
    g.edges.select(F.lit("edge").alias("type"), F.col("edge_id").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", props, "weight", "valid_from", "valid_to").write.mode("overwrite").json(f"{path}/edges")


# --- partitions by key

class ColdStore:
    """Graph parts under a root, by key: `<root>/nodes/partition_key=<key>` and `<root>/edges/...`, as Parquet or JSON."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def _path(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}/partition_key={key}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def write(self, key: str, g: PropertyGraph) -> None:
        g.nodes.write.mode("overwrite").format(self.fmt).save(self._path("nodes", key))
        g.edges.write.mode("overwrite").format(self.fmt).save(self._path("edges", key))

    def read(self, key: str) -> PropertyGraph | None:
        """None if there is no such part."""
        fs, path = self._fs()
        if not fs.exists(path(self._path("nodes", key))):
            return None
        load = lambda kind, schema: self.spark.read.schema(schema).format(self.fmt).load(self._path(kind, key))
        return PropertyGraph.of(load("nodes", NODES), load("edges", EDGES))

    def list(self) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/nodes")
        return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, key: str) -> bool:
        fs, path = self._fs()
        gone = fs.exists(path(self._path("nodes", key)))
        for kind in ("nodes", "edges"):
            fs.delete(path(self._path(kind, key)), True)
        return gone


# --- results

def to_utf8(df: DataFrame) -> DataFrame:
    """Every column as nullable text: strings as they are, anything else as JSON."""
    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string":
            return c.alias(name)
        return (F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")).alias(name)

    return df.select(*(text(n, k) for n, k in df.dtypes))


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def batches(df: DataFrame, rows: int = 10_000) -> Iterator[list]:
    """Rows in lists of `rows`, a partition at a time."""
    out = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        out.append(r)
        if len(out) == rows:
            yield out
            out = []
    if out:
        yield out


def export_nodes(g: PropertyGraph, keys: Sequence[str] = ()) -> DataFrame:
    """(node_id, labels joined by commas, and the properties named, as text)"""
    return g.nodes.select("node_id", F.array_join("labels", ",").alias("labels"), *(F.get_json_object("properties", f"$.{k}").alias(k) for k in keys))


def export_edges(g: PropertyGraph, keys: Sequence[str] = ()) -> DataFrame:
    return g.edges.select("edge_id", F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", "weight", *(F.get_json_object("properties", f"$.{k}").alias(k) for k in keys))


def export_bfs(g: PropertyGraph, start: int, max_depth: int = 3, ts: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    from graphspark.operators.traverse import bfs

    near = bfs(g.at(ts) if ts is not None else g, start, max_depth)
    return near.join(export_nodes(g, keys), "node_id", "left")


