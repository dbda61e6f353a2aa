"""The property graph: element tables registered under labels and edge types, and the canonical views over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id long, labels array<string>, properties string, embedding array<float>"
EDGES = "edge_id long, src long, dst long, edge_type string, properties string, weight double, valid_from long, valid_to long"
DEFAULT_EDGE_TYPE = "RELATED_TO"


#: Ids up to so many are pushed to a scan as values; more are joined.
FEW_IDS = 256
#: Tables of changes that a snapshot holds before they are put together.
CHANGES = 8


@dataclass(frozen=True)
class Key:
    """How ids come from a column of the source: `base` + its value, which is below `size`."""

    column: str
    base: int
    size: int

    def holds(self, node: int) -> bool:
        return self.base <= node < self.base + self.size

    def among(self, ids: Iterable[int]) -> Column:
        """A filter on the source's own column, which the scan can take over."""
        return F.col(self.column).isin(*(i - self.base for i in ids if self.holds(i)))


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one label set (labels), or of any (labels None: then df has a labels column).

    df: node_id and property columns named as in `props` (property name -> column), with an embedding column if `embedded`.
    key: where node_id comes from, if known; df then has that column. change: rows added or changed after the first snapshot.
    """

    df: DataFrame
    props: dict[str, str]
    labels: tuple[str, ...] | None = None
    embedded: bool = False
    key: Key | None = None
    change: bool = False

    def canonical(self) -> DataFrame:
        labels = F.col("labels") if self.labels is None else F.array(*map(F.lit, self.labels))
        embedding = F.col("embedding").cast("array<float>") if self.embedded else F.lit(None).cast("array<float>")
        return self.df.select("node_id", labels.alias("labels"), as_json(self.props, self.df).alias("properties"), embedding.alias("embedding"))


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one type (edge_type), or of any (None: then df has an edge_type column).

    df: edge_id, src, dst, weight, valid_from, valid_to and property columns. Where the labels of the ends are declared,
    the compiler may leave out the join that would only check them.
    """

    df: DataFrame
    props: dict[str, str]
    edge_type: str | None = None
    src_labels: tuple[str, ...] | None = None
    dst_labels: tuple[str, ...] | None = None
    src_key: Key | None = None
    dst_key: Key | None = None
    id_key: Key | None = None
    change: bool = False

    def canonical(self) -> DataFrame:
        kind = F.col("edge_type") if self.edge_type is None else F.lit(self.edge_type)
        return self.df.select("edge_id", "src", "dst", kind.alias("edge_type"), as_json(self.props, self.df).alias("properties"), "weight", "valid_from", "valid_to")


def as_json(props: dict[str, str], df: DataFrame) -> Column:
    """Properties as a JSON object, without those that are null."""
    if "properties" in df.columns:
        return F.col("properties")
    return F.to_json(F.struct(*(F.col(f"`{c}`").alias(p) for p, c in sorted(props.items())))) if props else F.lit("{}")


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def valid_at(ts: int) -> Column:
    """Half-open validity [valid_from, valid_to) in epoch milliseconds; a null end is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= ts)) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts))


_SHAPE = re.compile(r"^OBJECT<(.*)>$", re.S)


def _json_fields(df: DataFrame, column: str) -> dict[str, str]:
    """Top-level keys and Spark types of a JSON object column, in one aggregate over all rows."""
    shape = df.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    found, depth, at = {}, 0, 0
    inner = (_SHAPE.match(shape or "") or [None, ""])[1]
    parts = []
    for i, c in enumerate(inner + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(inner[at:i].strip())
            at = i + 1
    for part in filter(None, parts):
        name, _, kind = part.partition(":")
        kind = kind.strip()
        if kind.startswith(("OBJECT", "ARRAY", "VARIANT")):
            kind = "string"
        elif kind.startswith("DECIMAL"):
            kind = "double"
        elif kind == "VOID":
            kind = "string"
        found[name.strip().strip("`")] = kind.lower()
    return found


def _typed(df: DataFrame, column: str = "properties") -> tuple[DataFrame, dict[str, str]]:
    """df with a typed column for each key of its JSON properties."""
    fields = _json_fields(df, column)
    parsed = F.try_parse_json(column)
    columns = {f"p_{k}": F.try_variant_get(parsed, f"$['{k}']", kind) for k, kind in fields.items()}
    return (df.withColumns(columns) if columns else df), {k: f"p_{k}" for k in fields}


def _full(tables: tuple) -> bool:
    return sum(t.change for t in tables) >= CHANGES


def _together(tables: tuple, new: DataFrame) -> DataFrame:
    """The new rows; with the changes so far if these have become too many tables."""
    return union([t.canonical() for t in tables if t.change] + [new]) if _full(tables) else new


def _settled(tables: tuple) -> tuple:
    return tuple(t for t in tables if not t.change) if _full(tables) else tables


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable snapshot. Everything is lazy; operators return DataFrames or new snapshots."""

    spark: SparkSession
    node_tables: tuple[NodeTable, ...]
    edge_tables: tuple[EdgeTable, ...]
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> "PropertyGraph":
        """From canonical frames (see NODES and EDGES; properties are JSON text). Types of properties are found once."""
        node_df, node_props = _typed(nodes)
        edge_df, edge_props = _typed(edges)
        return cls(nodes.sparkSession, (NodeTable(node_df, node_props, None, True),), (EdgeTable(edge_df, edge_props),))

    @property
    def nodes(self) -> DataFrame:
        return union(t.canonical() for t in self.node_tables)

    @property
    def edges(self) -> DataFrame:
        return union(t.canonical() for t in self.edge_tables)

    def edges_of(self, *types: str) -> DataFrame:
        """Edges of these types only, from the tables that can have them."""
        tables = [t for t in self.edge_tables if t.edge_type is None or not types or t.edge_type in types]
        if not tables:
            return self.edges.limit(0)
        out = union(t.canonical() for t in tables)
        return out.where(F.col("edge_type").isin(*types)) if types else out

    def lookup(self, *ids: int) -> DataFrame:
        """The nodes with these ids, from the tables that can have them, by filters on their own keys."""
        found = []
        for t in self.node_tables:
            if t.key is None:
                found.append(replace(t, df=t.df.where(F.col("node_id").isin(*ids))).canonical())
            elif any(map(t.key.holds, ids)):
                found.append(replace(t, df=t.df.where(t.key.among(ids))).canonical())
        return union(found) if found else self.nodes.limit(0)

    def lookup_edges(self, *ids: int) -> DataFrame:
        """The edges with these ids, in the same way."""
        found = []
        for t in self.edge_tables:
            if t.id_key is None:
                found.append(replace(t, df=t.df.where(F.col("edge_id").isin(*ids))).canonical())
            elif any(map(t.id_key.holds, ids)):
                found.append(replace(t, df=t.df.where(t.id_key.among(ids))).canonical())
        return union(found) if found else self.edges.limit(0)

    def touching(self, end: str, ids: Iterable[int], *types: str) -> DataFrame:
        """Edges with one of these ids at an end (src or dst), from the tables that can have them, by filters on their own keys."""
        ids, found = list(ids), []
        for t in self.edge_tables:
            key = t.src_key if end == "src" else t.dst_key
            if types and t.edge_type is not None and t.edge_type not in types:
                continue
            if key is None:
                found.append(replace(t, df=t.df.where(F.col(end).isin(*ids))).canonical())
            elif any(map(key.holds, ids)):
                found.append(replace(t, df=t.df.where(key.among(ids))).canonical())
        out = union(found) if found else self.edges.limit(0)
        return out.where(F.col("edge_type").isin(*types)) if types else out

    def at(self, ts: int) -> "PropertyGraph":
        """The graph as of a moment: every operator then works on it unchanged."""
        return replace(self, edge_tables=tuple(replace(t, df=t.df.where(valid_at(ts))) for t in self.edge_tables))

    def only(self, *types: str) -> "PropertyGraph":
        """The same nodes with edges of these types only; other tables aren't read."""
        tables = [t if t.edge_type is not None else replace(t, df=t.df.where(F.col("edge_type").isin(*types))) for t in self.edge_tables if t.edge_type is None or t.edge_type in types]
        return replace(self, edge_tables=tuple(tables))

    def subset(self, ids: DataFrame) -> "PropertyGraph":
        """Nodes whose node_id is in ids, and the edges between them."""
        return self._ends(ids.select("node_id").distinct(), "left_semi")

    def without(self, ids: DataFrame) -> "PropertyGraph":
        """Without the nodes whose node_id is in ids and every edge at them."""
        return self._ends(ids.select("node_id").distinct(), "left_anti")

    def _ends(self, ids: DataFrame, how: str) -> "PropertyGraph":
        nodes = tuple(replace(t, df=t.df.join(ids, "node_id", how)) for t in self.node_tables)

        def within(df: DataFrame) -> DataFrame:
            return df.join(ids.withColumnRenamed("node_id", "src"), "src", how).join(ids.withColumnRenamed("node_id", "dst"), "dst", how)

        return replace(self, node_tables=nodes, edge_tables=tuple(replace(t, df=within(t.df)) for t in self.edge_tables))

    def plus(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> "PropertyGraph":
        """With canonical rows added as tables of changes: only their properties are looked through, the rest stays typed."""
        out = self
        if nodes is not None:
            df, props = _typed(_together(self.node_tables, nodes))
            out = replace(out, node_tables=(*_settled(self.node_tables), NodeTable(df, props, None, True, change=True)))
        if edges is not None:
            df, props = _typed(_together(self.edge_tables, edges))
            out = replace(out, edge_tables=(*_settled(self.edge_tables), EdgeTable(df, props, change=True)))
        return out

    def register_function(self, name: str, fn: Callable[..., Column]) -> "PropertyGraph":
        """A snapshot whose queries know one more scalar function, a rule from columns to a column."""
        return replace(self, functions=self.functions | {name.lower(): fn})

    def query(self, text: str, compat: bool = False):
        """Run a statement; reads give a DataFrame, writes a (new graph, statistics) pair."""
        from graphspark.plans.compiler import run

        return run(self, text, compat)
