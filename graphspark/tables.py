"""The star-schema tables as a property graph: every row a node or an edge, ids disjoint by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.graph import EdgeTable, Key, NodeTable, PropertyGraph
from graphspark.session import read_table

KIND = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Vec": 7, "EventType": 8}
#: Fixed orders: of edge types, whose ids are apart, and of event types, which have no key of their own.
EDGE_TYPES = ("IN_REGION", "CUSTOMER_IN", "SUPPLIER_IN", "PLACED", "CONTAINS", "SUPPLIED_BY", "DID")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BASE = 10_000_000_000


def node_id(kind: str, key: Column) -> Column:
    return (F.lit(KIND[kind] * BASE + 1) + key.cast("long")).cast("long")


def key_of(kind: str, column: str) -> Key:
    return Key(column, KIND[kind] * BASE + 1, BASE - 1)


def _nodes(df: DataFrame, kind: str, key: str, prefix: str) -> NodeTable:
    props = {c.removeprefix(prefix): c for c in df.columns}
    return NodeTable(df.withColumn("node_id", node_id(kind, F.col(key))), props, (kind,), key=key_of(kind, key))


#: Bits of an edge id below those of its type.
EDGE_BITS = 56


def _edges(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str], number: str | Column, weight: Column | None = None, props: dict[str, str] | None = None, valid: tuple[Column, Column] | None = None) -> EdgeTable:
    """`number`: a column, or a rule on the row's own values; so an edge's id is the same in every run and filters pass it."""
    start, end = valid or (F.lit(None), F.lit(None))
    props, first = props or {}, EDGE_TYPES.index(kind) << EDGE_BITS
    if not isinstance(number, str):
        df, number = df.withColumn("__number", number.bitwiseAND((1 << EDGE_BITS) - 1)), "__number"
    out = df.select(
        (F.col(number).cast("long") + F.lit(first)).alias("edge_id"),
        node_id(src[0], F.col(src[1])).alias("src"),
        node_id(dst[0], F.col(dst[1])).alias("dst"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
        start.cast("long").alias("valid_from"),
        end.cast("long").alias("valid_to"),
        *dict.fromkeys([*props.values(), src[1], dst[1], number]),
    )
    return EdgeTable(out, props, kind, (src[0],), (dst[0],), key_of(*src), key_of(*dst), Key(number, first, 1 << EDGE_BITS))


def event_edges(events: DataFrame) -> DataFrame:
    """Each event of a user holds from its millisecond until the user's next."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", "event_type", "value", ms.alias("ms"))
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return e.withColumn("until", F.lead("ms").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))).withColumn("kind", kind)


_graphs: dict[tuple, PropertyGraph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of a folder; its plan, not its rows, is kept for the session."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _graphs:
        _graphs[key] = _star_graph(spark, sf_dir)
    return _graphs[key]


def _star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {n: read_table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")}
    types = spark.range(1).select(F.posexplode(F.array(*map(F.lit, EVENT_TYPES))).alias("key", "name"))
    nodes = (
        _nodes(t["region"], "Region", "r_regionkey", "r_"),
        _nodes(t["nation"], "Nation", "n_nationkey", "n_"),
        _nodes(t["customer"], "Customer", "c_custkey", "c_"),
        _nodes(t["supplier"], "Supplier", "s_suppkey", "s_"),
        _nodes(t["part"], "Part", "p_partkey", "p_"),
        _nodes(t["orders"], "Order", "o_orderkey", "o_"),
        NodeTable(types.withColumn("node_id", node_id("EventType", F.col("key"))), {"name": "name"}, ("EventType",), key=key_of("EventType", "key")),
        NodeTable(t["embeddings"].select(node_id("Vec", F.col("vec_id")).alias("node_id"), "vec_id", "label", "embedding"), {"label": "label"}, ("Vec",), True, key_of("Vec", "vec_id")),
    )
    lines = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "returnflag": "l_returnflag"}
    line = F.xxhash64(*sorted(t["lineitem"].columns))  # a line has no key; rows that repeat a line whole share an id
    edges = (
        _edges(t["nation"], "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey"),
        _edges(t["customer"], "CUSTOMER_IN", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey"),
        _edges(t["supplier"], "SUPPLIER_IN", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey"),
        _edges(t["orders"], "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey", F.col("o_totalprice"), {"priority": "o_orderpriority"}),
        _edges(t["lineitem"], "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), line, F.col("l_quantity"), lines),
        _edges(t["lineitem"], "SUPPLIED_BY", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), line, F.col("l_quantity"), lines),
        _edges(event_edges(t["events"]), "DID", ("Customer", "user_id"), ("EventType", "kind"), "event_id", props={"value": "value"}, valid=(F.col("ms"), F.col("until"))),
    )
    return PropertyGraph(spark, nodes, edges)
