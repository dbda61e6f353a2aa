"""Queries over the star-schema tables as a graph, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.functions import distance as D
from graphspark.graph import PropertyGraph, valid_at
from graphspark.operators import algorithms, gnn, linalg, mutate, partition, rag, sealed, traverse, vector
from graphspark.sources import io
from graphspark.session import cut, read_table, remove_dir, shared_dir
from graphspark.tables import BASE, EDGE_BITS, EDGE_TYPES, EVENT_TYPES, KIND, event_edges, node_id, star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(f"`{f.name}`", places) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema))


def gql(name: str, text: str, sql: str, places: int = 4) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(star_graph(spark, sf_dir).query(text), places)
    ORACLE[name] = sql


def query(sql: str | None = None, places: int = 6) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def nid(kind: str, key: str) -> str:
    """Node id in SQL."""
    return f"CAST({KIND[kind] * BASE + 1} + {key} AS BIGINT)"


# --- the query language

gql("gql_flagship", 'MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE c.mktsegment = "BUILDING" AND o.totalprice > 100000 RETURN c.name AS name, o.totalprice AS total, id(o) AS order_id ORDER BY o.totalprice DESC, id(o) LIMIT 20',
    f"SELECT c_name AS name, o_totalprice AS total, {nid('Order', 'o_orderkey')} AS order_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
gql("gql_label_scan", "MATCH (s:Supplier) RETURN id(s) AS id, s.name AS name, s.acctbal AS acctbal",
    f"SELECT {nid('Supplier', 's_suppkey')} AS id, s_name AS name, s_acctbal AS acctbal FROM supplier")
gql("gql_where_cmp", "MATCH (p:Part) WHERE p.size >= 10 AND p.size < 20 AND p.retailprice <> 900.0 RETURN p.name AS name, p.size AS size, p.brand AS brand",
    "SELECT p_name AS name, p_size AS size, p_brand AS brand FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <> 900.0")
gql("gql_where_bool", 'MATCH (o:Order) WHERE (o.orderstatus = "F" OR o.orderpriority = "2-HIGH") AND NOT o.totalprice < 250000 RETURN id(o) AS id, o.orderstatus AS status',
    f"SELECT {nid('Order', 'o_orderkey')} AS id, o_orderstatus AS status FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '2-HIGH') AND NOT o_totalprice < 250000")
gql("gql_null_ordering", "MATCH (n) WHERE n.acctbal < 0 AND n.retailprice <> 900.0 RETURN count(*) AS n",
    """SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM supplier WHERE s_acctbal < 0) + (SELECT count(*) FROM part WHERE p_retailprice <> 900.0)
       + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM embeddings) + 5 AS n""")
gql("gql_null_sort", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, n.missing AS missing, n.name AS name ORDER BY n.missing, r.name DESC, n.name SKIP 3 LIMIT 10",
    "SELECT r_name AS region, CAST(NULL AS VARCHAR) AS missing, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name DESC, n_name LIMIT 10 OFFSET 3")
gql("gql_is_null", "MATCH (n) WHERE n.acctbal IS NULL AND n.size IS NOT NULL RETURN n.name AS name, n.size AS size",
    "SELECT p_name AS name, p_size AS size FROM part WHERE p_size IS NOT NULL")
gql("gql_arith", "MATCH (p:Part) RETURN id(p) AS id, p.size * 2 + 1 AS a, p.size / 7 AS b, p.size % 7 AS c, -p.size - 1 AS d, p.retailprice / 2 AS e",
    f"SELECT {nid('Part', 'p_partkey')} AS id, p_size * 2 + 1 AS a, p_size // 7 AS b, p_size % 7 AS c, -p_size - 1 AS d, round(p_retailprice / 2, 4) AS e FROM part")
gql("gql_string_concat", 'MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.name + "/" + c.mktsegment AS label',
    "SELECT c_name || '/' || c_mktsegment AS label FROM customer WHERE c_acctbal > 9000")
gql("gql_div_zero_null", "MATCH (n:Nation) RETURN n.name AS name, 10 / n.regionkey AS q, 10 % n.regionkey AS r",
    "SELECT n_name AS name, CASE WHEN n_regionkey <> 0 THEN 10 // n_regionkey END AS q, CASE WHEN n_regionkey <> 0 THEN 10 % n_regionkey END AS r FROM nation")
gql("gql_inline_props", 'MATCH (c:Customer {mktsegment: "MACHINERY", nationkey: 3}) RETURN c.name AS name',
    "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3")
gql("gql_inline_strict", "MATCH (p:Part {size: 30}) RETURN count(*) AS n, count(p) AS m", "SELECT count(*) AS n, count(*) AS m FROM part WHERE p_size = 30")
gql("gql_expand_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region",
    "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
gql("gql_expand_in", 'MATCH (r:Region {name: "ASIA"})<-[:IN_REGION]-(n)<-[:CUSTOMER_IN]-(c) RETURN c.name AS customer, n.name AS nation',
    "SELECT c_name AS customer, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
gql("gql_expand_undirected", "MATCH (n:Nation {nationkey: 3})-[e]-(x) RETURN id(x) AS id, type(e) AS type",
    f"""SELECT {nid('Region', 'n_regionkey')} AS id, 'IN_REGION' AS type FROM nation WHERE n_nationkey = 3
        UNION ALL SELECT {nid('Customer', 'c_custkey')}, 'CUSTOMER_IN' FROM customer WHERE c_nationkey = 3
        UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'SUPPLIER_IN' FROM supplier WHERE s_nationkey = 3""")
gql("gql_multi_type", "MATCH (x)-[e:CUSTOMER_IN|SUPPLIER_IN]->(n:Nation) RETURN n.name AS nation, type(e) AS type, count(*) AS n",
    """SELECT n_name AS nation, type, count(*) AS n FROM (SELECT c_nationkey AS k, 'CUSTOMER_IN' AS type FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER_IN' FROM supplier)
       JOIN nation ON k = n_nationkey GROUP BY ALL""")
gql("gql_multi_label", "MATCH (x:Customer:Supplier) RETURN count(*) AS n", "SELECT 0 AS n")
gql("gql_two_hop", 'MATCH (c:Customer)-[:PLACED]->(o)-[l:CONTAINS]->(p:Part) WHERE p.brand = "Brand#2" AND l.quantity > 45 RETURN c.name AS customer, p.name AS part, l.quantity AS quantity',
    """SELECT c_name AS customer, p_name AS part, l_quantity AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
       WHERE p_brand = 'Brand#2' AND l_quantity > 45""")
gql("gql_three_hop", 'MATCH (r:Region)<-[:IN_REGION]-(n)<-[:CUSTOMER_IN]-(c)-[p:PLACED]->(o) WHERE o.orderstatus = "O" RETURN r.name AS region, count(*) AS orders, sum(o.totalprice) AS total',
    """SELECT r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
       WHERE o_orderstatus = 'O' GROUP BY r_name""", 2)
gql("gql_edge_props", 'MATCH (o:Order)-[l:CONTAINS]->(p) WHERE l.discount > 0.09 AND l.returnflag = "R" RETURN id(o) AS order_id, id(p) AS part_id, l.extendedprice AS price',
    f"SELECT {nid('Order', 'l_orderkey')} AS order_id, {nid('Part', 'l_partkey')} AS part_id, l_extendedprice AS price FROM lineitem WHERE l_discount > 0.09 AND l_returnflag = 'R'")
gql("gql_edge_weight", "MATCH (c)-[p:PLACED]->(o) WHERE p.weight > 490000 RETURN p.source AS src, p.target AS dst, p.weight AS weight",
    f"SELECT {nid('Customer', 'o_custkey')} AS src, {nid('Order', 'o_orderkey')} AS dst, o_totalprice AS weight FROM orders WHERE o_totalprice > 490000")
gql("gql_distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.type AS type", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
gql("gql_order_skip_limit", "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS acctbal ORDER BY c.acctbal DESC, c.name SKIP 5 LIMIT 7",
    "SELECT c_name AS name, c_acctbal AS acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 7 OFFSET 5")
gql("gql_count_star", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders")
gql("gql_count_expr", "MATCH (n) RETURN count(n.acctbal) AS n, count(*) AS nodes",
    "SELECT (SELECT count(c_acctbal) FROM customer) + (SELECT count(s_acctbal) FROM supplier) AS n, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM embeddings) + 5 AS nodes")
gql("gql_count_empty", "MATCH (n:Nobody) RETURN count(*) AS n", "SELECT 0 AS n")
gql("gql_id_labels_type", "MATCH (s:Supplier)-[e]->(n:Nation) RETURN id(s) AS id, toString(labels(s)) AS labels, type(e) AS type",
    f"""SELECT {nid('Supplier', 's_suppkey')} AS id, '["Supplier"]' AS labels, 'SUPPLIER_IN' AS type FROM supplier""")
gql("gql_tostring", 'MATCH (p:Part) WHERE p.size > 45 RETURN toString(p.size) + "x" AS size, toString(p.missing) AS missing',
    "SELECT CAST(p_size AS VARCHAR) || 'x' AS size, 'null' AS missing FROM part WHERE p_size > 45")
gql("gql_tointeger", 'MATCH (c:Customer) RETURN id(c) AS id, toInteger(c.acctbal) AS whole, toInteger("3.7") AS none, toInteger(" 3") AS blank, toInteger("42") AS number',
    f"SELECT {nid('Customer', 'c_custkey')} AS id, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS none, CAST(NULL AS BIGINT) AS blank, 42 AS number FROM customer")
gql("gql_alias", "MATCH (r:Region) RETURN r.name, r.regionkey AS key", 'SELECT r_name AS "r.name", r_regionkey AS key FROM region')
gql("gql_equal_null", "MATCH (n:Nation) WHERE n.missing = null AND n.name <> null RETURN count(*) AS n", "SELECT count(*) AS n FROM nation")
gql("gql_truthiness", "MATCH (n:Nation) WHERE NOT n.regionkey RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey = 0")

# extensions: grouping, string tests, several patterns, anti-patterns, bounded walks
gql("gqlx_group_count", "MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation) RETURN n.name AS nation, c.mktsegment AS segment, count(*) AS n",
    "SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
gql("gqlx_sum_avg_min_max", "MATCH (p:Part) RETURN p.type AS type, sum(p.size) AS total, avg(p.retailprice) AS mean, min(p.size) AS low, max(p.retailprice) AS high",
    "SELECT p_type AS type, sum(p_size)::BIGINT AS total, round(avg(p_retailprice), 4) AS mean, min(p_size) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL")
gql("gqlx_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, toString(collect(n.name)) AS nations",
    "SELECT r_name AS region, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
gql("gqlx_starts_with", 'MATCH (p:Part) WHERE p.name STARTS WITH "small" OR p.name ENDS WITH "ring" RETURN id(p) AS id, p.name AS name',
    f"SELECT {nid('Part', 'p_partkey')} AS id, p_name AS name FROM part WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring')")
gql("gqlx_contains", 'MATCH (p:Part) WHERE p.name CONTAINS "ed" AND p.size IN [1, 2, 3, 5, 8] RETURN id(p) AS id, p.name AS name, p.size AS size',
    f"SELECT {nid('Part', 'p_partkey')} AS id, p_name AS name, p_size AS size FROM part WHERE contains(p_name, 'ed') AND p_size IN (1, 2, 3, 5, 8)")
gql("gqlx_anti_pattern", 'MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(o:Order {orderpriority: "1-URGENT"}) AND c.acctbal > 0 RETURN c.name AS name',
    "SELECT c_name AS name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
gql("gqlx_in", 'MATCH (o:Order) WHERE o.orderstatus IN ["F", "P"] AND NOT o.orderpriority IN ["1-URGENT"] RETURN o.orderstatus AS status, o.orderpriority AS priority, count(*) AS n',
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT' GROUP BY ALL")
gql("gqlx_tofloat_toboolean", 'MATCH (n:Nation) RETURN n.name AS name, toFloat("1.5") + toFloat(n.regionkey) AS f, toBoolean("TRUE") AS yes, toBoolean("maybe") AS none',
    "SELECT n_name AS name, 1.5 + n_regionkey::DOUBLE AS f, true AS yes, CAST(NULL AS BOOLEAN) AS none FROM nation")
gql("gqlx_ends_with", 'MATCH (c:Customer) WHERE c.name ENDS WITH "7" RETURN c.name AS name', "SELECT c_name AS name FROM customer WHERE ends_with(c_name, '7')")
gql("gqlx_semi_pattern", 'MATCH (p:Part) WHERE (p)<-[:CONTAINS]-(o:Order {orderpriority: "1-URGENT"}) RETURN id(p) AS id',
    f"SELECT {nid('Part', 'p_partkey')} AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')")
gql("gqlx_multi_match", 'MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation) MATCH (s:Supplier)-[:SUPPLIER_IN]->(n) WHERE c.mktsegment = "FURNITURE" RETURN n.name AS nation, count(*) AS pairs',
    "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE' GROUP BY ALL")
gql("gqlx_var_length", 'MATCH (r:Region {name: "EUROPE"})<-[*1..2]-(x) RETURN id(x) AS id',
    f"""WITH n AS (SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
        SELECT {nid('Nation', 'k')} AS id FROM n UNION ALL SELECT {nid('Customer', 'c_custkey')} FROM customer JOIN n ON c_nationkey = k UNION ALL SELECT {nid('Supplier', 's_suppkey')} FROM supplier JOIN n ON s_nationkey = k""")
gql("gqlx_order_alias", "MATCH (o:Order) RETURN o.orderpriority AS priority, count(*) AS n, max(o.totalprice) AS top ORDER BY n DESC, priority LIMIT 3",
    "SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL ORDER BY n DESC, priority LIMIT 3")
gql("gqlx_cycle", "MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s)-[:SUPPLIER_IN]->(n)<-[:CUSTOMER_IN]-(c) WHERE o.totalprice > 495000 RETURN id(c) AS c, id(s) AS s, count(*) AS n",
    f"""SELECT {nid('Customer', 'c_custkey')} AS c, {nid('Supplier', 's_suppkey')} AS s, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey
        JOIN lineitem b ON b.l_partkey = a.l_partkey JOIN supplier ON s_suppkey = b.l_suppkey AND s_nationkey = c_nationkey WHERE o_totalprice > 495000 GROUP BY c_custkey, s_suppkey""")
gql("gqlx_comma_cross", "MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey RETURN a.name AS a, b.name AS b",
    "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")

# --- traversals

#: Nation 3: it has edges out to a region and in from customers and suppliers.
NATION = KIND["Nation"] * BASE + 4
CUSTOMER = KIND["Customer"] * BASE + 1


def _around(direction: str) -> Query:
    return lambda spark, sf_dir: traverse.neighbors(star_graph(spark, sf_dir), NATION, direction).select("node_id", "edge_type", "weight")


_OUT = f"SELECT {nid('Region', 'n_regionkey')} AS node_id, 'IN_REGION' AS edge_type, 1.0::DOUBLE AS weight FROM nation WHERE n_nationkey = 3"
_IN = f"SELECT {nid('Customer', 'c_custkey')} AS node_id, 'CUSTOMER_IN' AS edge_type, 1.0::DOUBLE AS weight FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'SUPPLIER_IN', 1.0::DOUBLE FROM supplier WHERE s_nationkey = 3"
for _name, _dir, _sql in (("neighbors_out", "outgoing", _OUT), ("neighbors_in", "incoming", _IN), ("neighbors_both", "both", f"{_OUT} UNION ALL {_IN}")):
    QUERIES[_name], ORACLE[_name] = _around(_dir), _sql


@query(f"SELECT {nid('Order', 'o_orderkey')} AS node_id, o_totalprice AS weight FROM orders WHERE o_custkey = 0")
def neighbors_typed(spark, sf_dir):
    return traverse.neighbors(star_graph(spark, sf_dir), CUSTOMER, "outgoing", "PLACED").select("node_id", "weight")


@query(f"SELECT {nid('Nation', 'n_nationkey')} AS src, {nid('Region', 'n_regionkey')} AS dst FROM nation")
def find_edges_by_type(spark, sf_dir):
    return star_graph(spark, sf_dir).edges_of("IN_REGION").select("src", "dst")


@query(f"SELECT {nid('Part', 'p_partkey')} AS node_id FROM part")
def find_by_label(spark, sf_dir):
    return star_graph(spark, sf_dir).nodes.where(F.array_contains("labels", "Part")).select("node_id")


@query(f"SELECT {nid('Supplier', 's_suppkey')} AS node_id, 'Supplier' AS labels, s_name AS name, false AS has_embedding FROM supplier WHERE s_suppkey = 7")
def point_lookup(spark, sf_dir):
    n = star_graph(spark, sf_dir).lookup(KIND["Supplier"] * BASE + 8)
    return n.select("node_id", F.array_join("labels", ",").alias("labels"), F.get_json_object("properties", "$.name").alias("name"), F.col("embedding").isNotNull().alias("has_embedding"))


_E = f"""e AS (SELECT {nid('Nation', 'n_nationkey')} AS src, {nid('Region', 'n_regionkey')} AS dst FROM nation
  UNION ALL SELECT {nid('Customer', 'c_custkey')}, {nid('Nation', 'c_nationkey')} FROM customer
  UNION ALL SELECT {nid('Supplier', 's_suppkey')}, {nid('Nation', 's_nationkey')} FROM supplier
  UNION ALL SELECT {nid('Customer', 'o_custkey')}, {nid('Order', 'o_orderkey')} FROM orders
  UNION ALL SELECT {nid('Order', 'l_orderkey')}, {nid('Part', 'l_partkey')} FROM lineitem
  UNION ALL SELECT {nid('Part', 'l_partkey')}, {nid('Supplier', 'l_suppkey')} FROM lineitem
  UNION ALL SELECT {nid('Customer', 'user_id')}, CAST({KIND['EventType'] * BASE} + list_position({list(EVENT_TYPES)}, event_type) AS BIGINT) FROM events)"""
_NODES = f"""n AS (SELECT {nid('Region', 'r_regionkey')} AS node_id, 'Region' AS label FROM region UNION ALL SELECT {nid('Nation', 'n_nationkey')}, 'Nation' FROM nation
  UNION ALL SELECT {nid('Customer', 'c_custkey')}, 'Customer' FROM customer UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'Supplier' FROM supplier
  UNION ALL SELECT {nid('Part', 'p_partkey')}, 'Part' FROM part UNION ALL SELECT {nid('Order', 'o_orderkey')}, 'Order' FROM orders
  UNION ALL SELECT {nid('Vec', 'vec_id')}, 'Vec' FROM embeddings UNION ALL SELECT CAST({KIND['EventType'] * BASE + 1} + i AS BIGINT), 'EventType' FROM range(5) t(i))"""
_BFS = f"{_E}, r AS (SELECT CAST({CUSTOMER} AS BIGINT) AS n, 0 AS d UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = n WHERE d < 3)"


@query(f"WITH RECURSIVE {_BFS} SELECT n AS node_id, min(d) AS depth FROM r GROUP BY n")
def bfs_depth3(spark, sf_dir):
    return traverse.bfs(star_graph(spark, sf_dir), CUSTOMER, 3)


@query(f"WITH RECURSIVE {_BFS}, {_NODES}, b AS (SELECT n AS node_id, min(d) AS level FROM r GROUP BY n) SELECT node_id, coalesce(level, -1) AS level FROM n LEFT JOIN b USING (node_id)")
def bfs_levels_all(spark, sf_dir):
    return traverse.bfs_levels(star_graph(spark, sf_dir), CUSTOMER, 3)


def similar(spark: SparkSession, sf_dir: str, k: int = 5, below: float | None = None) -> PropertyGraph:
    """Vectors as nodes, an edge to each of the k nearest by cosine, weighted by the distance."""
    e = read_table(spark, sf_dir, "embeddings")
    nodes = cut(e.select((F.col("vec_id") + 1).alias("node_id"), F.array(F.lit("Vec")).alias("labels"), F.to_json(F.struct("label")).alias("properties"), F.col("embedding").cast("array<float>").alias("embedding")))
    found = vector.knn_join(nodes, nodes, k)
    if below is not None:
        found = found.where(F.col("distance") < below)
    none = F.lit(None).cast("long")
    edges = cut(found.select(F.xxhash64("query_id", "node_id").alias("edge_id"), F.col("query_id").alias("src"), F.col("node_id").alias("dst"), F.lit("SIM").alias("edge_type"), F.lit("{}").alias("properties"), F.col("distance").alias("weight"), none.alias("valid_from"), none.alias("valid_to")))
    return PropertyGraph.of(nodes, edges)


_SIM = """v AS MATERIALIZED (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS e FROM embeddings),
sim AS MATERIALIZED (SELECT src, dst, w FROM (SELECT a.id AS src, b.id AS dst, 1 - list_cosine_similarity(a.e, b.e) AS w FROM v a JOIN v b ON a.id <> b.id)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 12), dst) <= 5)"""


def _sssp_sql(rounds: int, source: int) -> str:
    steps = [f"d0 AS (SELECT CAST({source} AS BIGINT) AS id, 0.0::DOUBLE AS c)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT * FROM d{i - 1} UNION ALL SELECT dst, c + w FROM d{i - 1} JOIN sim ON src = id) GROUP BY id)")
    return f"WITH {_SIM}, {', '.join(steps)} SELECT id AS node_id, round(c, 6) AS cost FROM d{rounds}"


@query(_sssp_sql(40, 1))
def sssp_weighted(spark, sf_dir):
    return traverse.sssp(similar(spark, sf_dir), 1).select("node_id", "cost")


@query(f"WITH RECURSIVE {_SIM}, r AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN sim ON src = n WHERE d < 12) SELECT n AS node_id, min(d)::DOUBLE AS hops FROM r GROUP BY n HAVING min(d) <= 12")
def shortest_path_len(spark, sf_dir):
    return traverse.sssp(similar(spark, sf_dir), 1, weighted=False, max_hops=12).select("node_id", F.col("cost").alias("hops"))


def _path_sql(rounds: int, source: int, target: int) -> str:
    steps = [f"d0 AS (SELECT CAST({source} AS BIGINT) AS id, 0.0::DOUBLE AS c, [{source}::BIGINT] AS p)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT id, min(c) AS c, arg_min(p, c) AS p FROM (SELECT * FROM d{i - 1} UNION ALL SELECT dst, c + w, list_append(p, dst) FROM d{i - 1} JOIN sim ON src = id) GROUP BY id)")
    return f"WITH {_SIM}, {', '.join(steps)} SELECT unnest(range(len(p)))::INT AS position, unnest(p) AS node_id FROM d{rounds} WHERE id = {target}"


@query(_path_sql(30, 1, 50))
def shortest_path(spark, sf_dir):
    return similar(spark, sf_dir).query("CALL algo.shortest_path(1, 50, true)").select("position", "node_id")


def _dfs_sql(arcs: str, start: int, depth: int, back: bool) -> str:
    """A stack of (node, depth) a step at a time; arcs: src and dst."""
    ahead = "list_reverse(ns)" if back else "ns"
    return f"""adj AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS ns FROM ({arcs}) GROUP BY src),
st AS (SELECT 0 AS i, [{{'n': {start}::BIGINT, 'd': 0}}] AS stack, []::BIGINT[] AS seen
  UNION ALL SELECT i + 1, CASE WHEN list_contains(seen, stack[-1].n) OR stack[-1].d >= {depth} OR ns IS NULL THEN stack[:-2]
    ELSE list_concat(stack[:-2], list_transform(list_filter({ahead}, lambda x: NOT list_contains(seen, x) AND x <> stack[-1].n), lambda x: {{'n': x, 'd': stack[-1].d + 1}})) END,
    CASE WHEN list_contains(seen, stack[-1].n) THEN seen ELSE list_append(seen, stack[-1].n) END FROM st LEFT JOIN adj ON src = stack[-1].n WHERE len(stack) > 0),
o AS (SELECT seen FROM st ORDER BY i DESC LIMIT 1)
SELECT unnest(range(len(seen)))::INT AS position, unnest(seen) AS node_id FROM o"""


def _ordered(spark: SparkSession, nodes: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(nodes)), "position int, node_id long")


@query(f"WITH RECURSIVE {_SIM}, {_dfs_sql('SELECT src, dst FROM sim', 1, 3, True)}")
def dfs_order(spark, sf_dir):
    return _ordered(spark, traverse.dfs(similar(spark, sf_dir), 1, 3))


# --- valid time

#: A moment in the middle of the events, and one two days later.
T1, T2 = 1_705_320_000_000, 1_705_492_800_000
_EV = f"""ev AS (SELECT {nid('Customer', 'user_id')} AS src, CAST({KIND['EventType'] * BASE} + list_position({list(EVENT_TYPES)}, event_type) AS BIGINT) AS dst, event_type, value,
  epoch_us(ts) // 1000 AS vf, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS vt FROM events)"""
_AT = "(vf IS NULL OR vf <= {t}) AND (vt IS NULL OR vt > {t})"


@query(f"WITH {_EV} SELECT src, dst, vf AS valid_from, vt AS valid_to FROM ev WHERE {_AT.format(t=T1)}")
def edges_valid_at(spark, sf_dir):
    return star_graph(spark, sf_dir).edges_of("DID").where(valid_at(T1)).select("src", "dst", "valid_from", "valid_to")


@query(f"WITH {_EV} SELECT dst AS node_id, 'DID' AS edge_type FROM ev WHERE src = {CUSTOMER} AND {_AT.format(t=T1)}")
def neighbors_at(spark, sf_dir):
    return traverse.neighbors(star_graph(spark, sf_dir).at(T1), CUSTOMER, "outgoing", "DID").select("node_id", "edge_type")


@query(f"""WITH RECURSIVE {_EV}, u AS (SELECT src AS a, dst AS b FROM ev WHERE {_AT.format(t=T1)} UNION SELECT dst, src FROM ev WHERE {_AT.format(t=T1)}),
r AS (SELECT CAST({CUSTOMER} AS BIGINT) AS n, 0 AS d UNION SELECT b, d + 1 FROM r JOIN u ON a = n WHERE d < 2) SELECT n AS node_id, min(d) AS depth FROM r GROUP BY n""")
def bfs_at(spark, sf_dir):
    return traverse.bfs(star_graph(spark, sf_dir).only("DID").at(T1), CUSTOMER, 2, "both")


@query(f"""WITH {_EV}, a AS (SELECT DISTINCT dst AS node_id FROM ev WHERE src = {CUSTOMER} AND {_AT.format(t=T1)}), b AS (SELECT DISTINCT dst AS node_id FROM ev WHERE src = {CUSTOMER} AND {_AT.format(t=T2)})
SELECT node_id, CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM a FULL JOIN b USING (node_id)""")
def temporal_diff(spark, sf_dir):
    return traverse.temporal_diff(star_graph(spark, sf_dir).only("DID"), CUSTOMER, T1, T2).select("node_id", "status")


@query(f"""WITH {_EV}, m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id FROM events WHERE event_type = 'error')
SELECT event_id, count(*) AS others FROM m JOIN ev ON src = {nid('Customer', 'user_id')} AND vf <= ms AND (vt IS NULL OR vt > ms) GROUP BY event_id""")
def neighbors_asof(spark, sf_dir):
    """For each error the user's edges valid at that moment, an as-of join."""
    ev = event_edges(read_table(spark, sf_dir, "events")).select("user_id", F.col("ms").alias("valid_from"), F.col("until").alias("valid_to"))
    asked = read_table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return traverse.asof_edges(asked, ev, "user_id", "at").groupBy("event_id").agg(F.count("*").alias("others"))


@query(f"WITH RECURSIVE {_EV}, {_dfs_sql(f'SELECT src, dst FROM ev WHERE {_AT.format(t=T1)}', CUSTOMER, 3, False)}")
def dfs_at(spark, sf_dir):
    return _ordered(spark, traverse.dfs(star_graph(spark, sf_dir).only("DID").at(T1), CUSTOMER, 3, reverse=False))


#: Validity of the similarity edges by their ends, for weighted paths at a moment.
_SPAN = "(src * 7 + dst * 13) % 10"


@query(_sssp_sql(40, 1).replace("FROM sim ", "FROM sim_ ").replace("JOIN sim ON", "JOIN sim_ ON").replace(", d0 AS", f", sim_ AS (SELECT * FROM sim WHERE {_SPAN} <= 7), d0 AS", 1))
def weighted_paths_at(spark, sf_dir):
    """Least costs over the edges valid at a moment: an edge holds from 100 times a number from 0 to 9 on."""
    g = similar(spark, sf_dir)
    edges = g.edges.withColumn("valid_from", F.expr(f"100 * ({_SPAN})"))
    return traverse.sssp(PropertyGraph.of(g.nodes, edges).at(700), 1).select("node_id", "cost")


@query(f"WITH {_EV} SELECT dst AS node_id, 'DID' AS edge_type, 1.0::DOUBLE AS weight FROM ev WHERE src = {CUSTOMER} AND {_AT.format(t=T1)}")
def call_neighbors_at(spark, sf_dir):
    return star_graph(spark, sf_dir).only("DID").query(f"CALL temporal.neighbors_at({CUSTOMER}, {T1})").drop("edge_id")


@query(f"WITH {_EV} SELECT DISTINCT dst AS node_id, 1 AS depth FROM ev WHERE src = {CUSTOMER} AND {_AT.format(t=T1)} UNION ALL SELECT {CUSTOMER}, 0")
def call_bfs_at(spark, sf_dir):
    return star_graph(spark, sf_dir).only("DID").query(f"CALL temporal.bfs_at({CUSTOMER}, {T1}, 2)")


# --- algorithms

for _name, _dir, _ends in (("degree_out", "outgoing", "SELECT src AS x FROM e"), ("degree_in", "incoming", "SELECT dst AS x FROM e"), ("degree_both", "both", "SELECT src AS x FROM e UNION ALL SELECT dst FROM e")):
    QUERIES[_name] = lambda spark, sf_dir, d=_dir: rounded((lambda g: algorithms.degree_centrality(g.nodes, g.edges, d))(star_graph(spark, sf_dir)), 9)
    ORACLE[_name] = f"WITH {_E}, {_NODES}, d AS (SELECT x, count(*) AS c FROM ({_ends}) GROUP BY x) SELECT node_id, round(coalesce(c, 0) / ((SELECT count(*) FROM n) - 1), 9) AS centrality FROM n LEFT JOIN d ON x = node_id"


@query(f"""WITH {_E}, {_NODES}, k AS (SELECT 'IN_REGION' AS name, count(*) AS total FROM nation UNION ALL SELECT 'CUSTOMER_IN', count(*) FROM customer UNION ALL SELECT 'SUPPLIER_IN', count(*) FROM supplier
  UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events)
SELECT 'nodes' AS kind, '' AS name, count(*) AS total FROM n UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'label', label, count(*) FROM n GROUP BY label UNION ALL SELECT 'edge_type', name, total FROM k""")
def graph_stats(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return algorithms.graph_stats(g.nodes, g.edges)


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / c AS r FROM v, cnt)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT v.id, 0.15 / c + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM deg)) / c + 0.85 * coalesce(s.s, 0) AS r
  FROM v CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(r / d) AS s FROM sim JOIN deg USING (src) JOIN r{i - 1} ON src = id GROUP BY 1) s ON s.dst = v.id)""")
    return f"WITH {_SIM}, cnt AS (SELECT count(*) AS c FROM v), deg AS (SELECT src, count(*) AS d FROM sim GROUP BY src), {', '.join(steps)} SELECT id AS node_id, round(r, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql(10), 8)
def pagerank_10(spark, sf_dir):
    g = similar(spark, sf_dir)
    return algorithms.pagerank(g.nodes, g.edges, max_iterations=10, tolerance=0)


@query(f"""WITH RECURSIVE {_SIM}, s AS (SELECT src, dst FROM sim WHERE w < 0.7), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s),
c AS (SELECT id AS n, id AS l FROM v UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.n WHERE c.l < u.b) SELECT n AS node_id, min(l) AS component FROM c GROUP BY n""")
def wcc(spark, sf_dir):
    g = similar(spark, sf_dir, below=0.7)
    return algorithms.wcc(g.nodes, g.edges)


@query(f"""WITH RECURSIVE {_SIM}, s AS MATERIALIZED (SELECT src, dst FROM sim WHERE w < 0.62), c AS (SELECT id AS a, id AS b FROM v UNION SELECT c.a, s.dst FROM c JOIN s ON s.src = c.b)
SELECT x.a AS node_id, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def scc(spark, sf_dir):
    g = similar(spark, sf_dir, below=0.62)
    return algorithms.scc(g.nodes, g.edges)


@query("SELECT CAST(s_suppkey AS BIGINT) AS node_id, CASE WHEN s_suppkey % 50 < 10 AND s_suppkey - s_suppkey % 50 + 9 <= (SELECT max(s_suppkey) FROM supplier) THEN s_suppkey - s_suppkey % 50 ELSE s_suppkey END::BIGINT AS component FROM supplier")
def scc_chain(spark, sf_dir):
    """A chain through all suppliers with a cycle of ten in every fifty, by the distributed form."""
    p = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node_id"))
    chain = p.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    back = p.where("node_id % 50 = 0").select((F.col("node_id") + 9).alias("src"), F.col("node_id").alias("dst"))
    return algorithms.scc(p, chain.union(back), small=0)


def _betweenness_sql(levels: int) -> str:
    """Brandes by levels: paths counted outwards from every source, dependencies back inwards."""
    out = ["l0 AS MATERIALIZED (SELECT id AS s, id AS n, 1.0::DOUBLE AS g FROM v)", "seen0 AS MATERIALIZED (SELECT s, n FROM l0)"]
    for k in range(1, levels + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT s, dst AS n, sum(g) AS g FROM l{k - 1} JOIN sim ON src = n WHERE NOT EXISTS (SELECT 1 FROM seen{k - 1} z WHERE z.s = l{k - 1}.s AND z.n = dst) GROUP BY s, dst)")
        out.append(f"seen{k} AS MATERIALIZED (SELECT * FROM seen{k - 1} UNION ALL SELECT s, n FROM l{k})")
    out.append(f"b{levels} AS MATERIALIZED (SELECT s, n, g, 0.0::DOUBLE AS d FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        out.append(f"b{k} AS MATERIALIZED (SELECT a.s, a.n, a.g, coalesce(sum(a.g / b.g * (1 + b.d)), 0) AS d FROM l{k} a LEFT JOIN sim ON src = a.n LEFT JOIN b{k + 1} b ON b.s = a.s AND b.n = dst GROUP BY a.s, a.n, a.g)")
    every = " UNION ALL ".join(f"SELECT n, d FROM b{k}" for k in range(1, levels + 1))
    return f"WITH {_SIM}, {', '.join(out)}, t AS (SELECT n, sum(d) AS d FROM ({every}) GROUP BY n) SELECT id AS node_id, round(coalesce(d, 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2), 6) AS centrality FROM v LEFT JOIN t ON n = id"


@query(_betweenness_sql(24))
def betweenness(spark, sf_dir):
    g = similar(spark, sf_dir)
    return algorithms.betweenness(g.nodes, g.edges)


@query(_pagerank_sql(10).replace("WITH ", "WITH ", 1).replace(_SIM, _SIM + ", keep AS (SELECT vec_id + 1 AS k FROM embeddings WHERE label < 5), whole AS (SELECT * FROM v), every AS (SELECT * FROM sim)").replace("cnt AS (SELECT count(*) AS c FROM v)", "v2 AS MATERIALIZED (SELECT * FROM whole WHERE id IN (SELECT k FROM keep)), sim2 AS MATERIALIZED (SELECT * FROM every WHERE src IN (SELECT k FROM keep) AND dst IN (SELECT k FROM keep)), cnt AS (SELECT count(*) AS c FROM v2)").replace("FROM sim GROUP", "FROM sim2 GROUP").replace("FROM sim JOIN deg", "FROM sim2 JOIN deg").replace("FROM v, cnt", "FROM v2 v, cnt").replace("FROM v CROSS JOIN cnt", "FROM v2 v CROSS JOIN cnt"), 8)
def pagerank_restricted(spark, sf_dir):
    """Over the vectors of five labels; out-degrees count the edges between these only."""
    g = similar(spark, sf_dir)
    some = g.nodes.where(F.get_json_object("properties", "$.label").cast("int") < 5)
    return algorithms.pagerank(some, g.edges, max_iterations=10, tolerance=0, restrict_degree=True)


for _proc, _of in (("call_pagerank", "CALL algo.pagerank(0.85, 10, 0.0)"), ("call_degree", 'CALL algo.degree("outgoing")'), ("call_betweenness", "CALL algo.betweenness()")):
    QUERIES[_proc] = lambda spark, sf_dir, text=_of: rounded(similar(spark, sf_dir).query(text), 6)
ORACLE["call_pagerank"] = _pagerank_sql(10).replace("round(r, 8)", "round(r, 6)")
ORACLE["call_degree"] = f"WITH {_SIM} SELECT id AS node_id, round(count(src) / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM v LEFT JOIN sim ON src = id GROUP BY id"
ORACLE["call_betweenness"] = ORACLE["betweenness"]
for _proc in ("wcc", "scc"):
    _below = {"wcc": 0.7, "scc": 0.62}[_proc]
    QUERIES[f"call_{_proc}"] = lambda spark, sf_dir, text=f"CALL algo.{_proc}()", b=_below: similar(spark, sf_dir, below=b).query(text)
    ORACLE[f"call_{_proc}"] = ORACLE[_proc]


@query()
def louvain_modularity(spark, sf_dir):
    g = similar(spark, sf_dir)
    return algorithms.modularity(algorithms.louvain(g.nodes, g.edges), g.edges)


@query(f"""WITH {_SIM}, c AS (SELECT vec_id + 1 AS id, label FROM embeddings), e AS (SELECT a.label AS la, b.label AS lb, w FROM sim JOIN c a ON a.id = src JOIN c b ON b.id = dst),
x AS (SELECT la AS l, CASE WHEN la = lb THEN w ELSE 0 END AS inner_, w FROM e UNION ALL SELECT lb, CASE WHEN la = lb THEN w ELSE 0 END, w FROM e), p AS (SELECT l, sum(w) AS t, sum(inner_) AS i FROM x GROUP BY l)
SELECT round(sum(i) / sum(t) - sum(t * t) / (sum(t) * sum(t)), 6) AS modularity FROM p""")
def modularity_by_label(spark, sf_dir):
    g = similar(spark, sf_dir)
    labels = g.nodes.select("node_id", F.get_json_object("properties", "$.label").cast("int").alias("community"))
    return algorithms.modularity(labels, g.edges)


@query(f"WITH {_SIM} SELECT src - 1 AS \"row\", round(sum(w * dst), 6) AS value FROM sim GROUP BY src")
def spmv(spark, sf_dir):
    g = similar(spark, sf_dir)
    x = g.nodes.select((F.col("node_id") - 1).alias("i"), F.col("node_id").cast("double").alias("value"))
    return linalg.spmv(linalg.csr_entries(g.nodes, g.edges), x)


@query(f"WITH {_SIM} SELECT id AS node_id, count(src) AS degree FROM v LEFT JOIN sim ON src = id GROUP BY id")
def csr_out_degree(spark, sf_dir):
    g = similar(spark, sf_dir)
    return linalg.out_degrees(g.nodes, g.edges)


@query(f"WITH {_SIM} SELECT dst - 1 AS \"row\", src - 1 AS col, round(w, 6) AS value FROM sim")
def csr_transpose(spark, sf_dir):
    g = similar(spark, sf_dir)
    return linalg.transpose(linalg.csr_entries(g.nodes, g.edges))


_FEATURES = "f AS (SELECT id, unnest(range(0, len(e))) AS k, unnest(e) AS x FROM v)"


def _features(g: PropertyGraph) -> DataFrame:
    return g.nodes.select("node_id", F.col("embedding").alias("features"))


@query(f"WITH {_SIM}, {_FEATURES} SELECT src - 1 AS \"row\", k::INT AS k, round(sum(w * x), 6) AS value FROM sim JOIN f ON f.id = dst GROUP BY ALL")
def spmm(spark, sf_dir):
    g = similar(spark, sf_dir)
    dense = _features(g).select((F.col("node_id") - 1).alias("i"), F.col("features").cast("array<double>").alias("features"))
    return linalg.spmm(linalg.csr_entries(g.nodes, g.edges), dense).select("row", F.posexplode("features").alias("k", "value"))


for _agg, _fn in (("mean", "avg"), ("sum", "sum"), ("max", "max")):
    QUERIES[f"message_passing_{_agg}"] = lambda spark, sf_dir, a=_agg: rounded((lambda g: linalg.message_passing(_features(g), g.edges, a, "relu"))(similar(spark, sf_dir)).select("node_id", F.posexplode("features").alias("k", "value")))
    ORACLE[f"message_passing_{_agg}"] = f"""WITH {_SIM}, {_FEATURES}, u AS (SELECT src AS a, dst AS b, w FROM sim UNION ALL SELECT dst, src, w FROM sim)
SELECT a AS node_id, k::INT AS k, round(greatest({_fn}(w * x), 0), 6) + 0.0 AS value FROM u JOIN f ON f.id = b GROUP BY a, k"""


@query(f"""WITH {_SIM}, {_FEATURES}, u AS (SELECT src AS a, dst AS b, w FROM sim UNION ALL SELECT dst, src, w FROM sim), g AS (SELECT a, k, avg(w * x) AS x FROM u JOIN f ON f.id = b GROUP BY a, k),
z AS (SELECT f.id, j, sum(coalesce(g.x, 0) * ((f.k * 7 + j * 3) % 5 - 2) / 10.0 + f.x * ((f.k * 3 + j * 5) % 7 - 3) / 10.0) + 0.1 * j AS z FROM f LEFT JOIN g ON g.a = f.id AND g.k = f.k CROSS JOIN range(3) t(j) GROUP BY f.id, j)
SELECT id AS node_id, j::INT AS k, round(greatest(z, 0), 6) + 0.0 AS value FROM z""")
def own_weights(spark, sf_dir):
    """A layer with weights for neighbours and for the node itself, and a bias."""
    import numpy as np

    g = similar(spark, sf_dir)
    i, j = np.arange(64)[:, None], np.arange(3)[None, :]
    out = linalg.weighted_message_passing(_features(g), g.edges, ((i * 7 + j * 3) % 5 - 2) / 10, ((i * 3 + j * 5) % 7 - 3) / 10, 0.1 * np.arange(3), "mean", "relu")
    return out.select("node_id", F.posexplode("features").alias("k", "value"))


@query()
def sage_sample(spark, sf_dir):
    g = similar(spark, sf_dir)
    return traverse.sample_neighbors(g.edges, g.nodes, [3, 2], seed=1)


# --- vectors

_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _knn(metric: str) -> Query:
    def run(spark, sf_dir):
        nodes = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
        q = nodes.where("node_id = 0").first()["embedding"]
        return rounded(vector.knn(nodes, q, 10, metric))

    return run


for _name, _metric, _sql in (("knn_cosine", "cosine", "1 - list_cosine_similarity(embedding::DOUBLE[], q.v)"), ("knn_euclidean", "euclidean", "list_distance(embedding::DOUBLE[], q.v)"), ("knn_dot", "dot", "-list_inner_product(embedding::DOUBLE[], q.v)")):
    QUERIES[_name], ORACLE[_name] = _knn(_metric), f"WITH {_Q} SELECT vec_id AS node_id, round({_sql}, 6) + 0.0 AS distance FROM embeddings, q ORDER BY {_sql}, vec_id LIMIT 10"


@query(f"WITH {_SIM} SELECT src AS query_id, row_number() OVER (PARTITION BY src ORDER BY round(w, 12), dst)::INT AS rank, dst AS node_id, round(w, 6) AS distance FROM sim")
def knn_join(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("node_id"), "embedding")
    return vector.knn_join(nodes, nodes, 5)


@query(f"WITH {_Q}, c AS (SELECT * FROM embeddings WHERE vec_id % 7 <> 3 OR vec_id < 50) SELECT vec_id AS node_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 6) + 0.0 AS distance FROM c, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q.v), vec_id LIMIT 10")
def knn_index(spark, sf_dir):
    """Built without some rows, which are then inserted, and others removed; saved, loaded, and searched in all its cells."""
    nodes = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    index = vector.InvertedIndex.build(nodes.where("node_id >= 20"), cells=32).insert(nodes.where("node_id < 20")).remove(nodes.where("node_id % 7 = 3 and node_id >= 50"))
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(path)
    out = cut(vector.InvertedIndex.load(spark, path).search(nodes.where("node_id = 0").first()["embedding"], 10, probes=32))
    remove_dir(spark, path)
    return out


@query()
def knn_inverted(spark, sf_dir):
    """As many cells as were measured to be needed."""
    nodes = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return vector.InvertedIndex.build(nodes, cells=32).search(nodes.where("node_id = 0").first()["embedding"], 10)


@query(f"WITH {_Q.replace('vec_id = 0', 'vec_id = 3')} SELECT vec_id + 1 AS node_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 6) + 0.0 AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q.v), vec_id LIMIT 5")
def call_vector_search(spark, sf_dir):
    g = similar(spark, sf_dir)
    return g.query(f"CALL db.index.vector.search([{', '.join(f'{x:.9f}' for x in vector.embedding_of(g, 4))}], 5)")


@query(f"""WITH RECURSIVE {_SIM}, q AS (SELECT e AS v FROM v WHERE id = 8), r AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN sim ON src = n WHERE d < 3), b AS (SELECT n, min(d) AS d FROM r GROUP BY n)
SELECT n AS node_id, round(0.5 * (1 - list_cosine_similarity(v.e, q.v)) + 0.5 * d / 4, 6) AS score FROM b JOIN v ON v.id = n, q WHERE n <> 1 ORDER BY 0.5 * (1 - list_cosine_similarity(v.e, q.v)) + 0.5 * d / 4, n LIMIT 10""")
def hybrid_search(spark, sf_dir):
    g = similar(spark, sf_dir)
    return vector.hybrid_search(g, 1, vector.embedding_of(g, 8), 3, 10, 0.5)


def call_hybrid(spark, sf_dir):
    g = similar(spark, sf_dir)
    return rounded(g.query(f"CALL hybrid.search(1, [{', '.join(f'{x:.9f}' for x in vector.embedding_of(g, 8))}], 3, 10, 0.5)"))


QUERIES["call_hybrid"], ORACLE["call_hybrid"] = call_hybrid, ORACLE["hybrid_search"]


@query(f"WITH {_SIM}, q AS (SELECT e AS v FROM v WHERE id = 8) SELECT dst AS node_id, round(1 - list_cosine_similarity(v.e, q.v), 6) AS distance FROM sim JOIN v ON v.id = dst, q WHERE src = 1 ORDER BY 1 - list_cosine_similarity(v.e, q.v), dst LIMIT 3")
def semantic_neighbors(spark, sf_dir):
    g = similar(spark, sf_dir)
    return vector.semantic_neighbors(g, 1, vector.embedding_of(g, 8), 3)


def _walk_sql(hops: int) -> str:
    """One greedy step after the other."""
    d = "1 - list_cosine_similarity(v.e, q.v)"
    steps = [f"w0 AS (SELECT 0 AS position, id AS node_id, {d} AS distance, [id] AS seen FROM v, q WHERE id = 1)"]
    for k in range(1, hops + 1):
        steps.append(f"w{k} AS (SELECT {k} AS position, id AS node_id, {d} AS distance, list_append(seen, id) AS seen FROM w{k - 1} w JOIN sim ON src = w.node_id JOIN v ON v.id = dst, q WHERE NOT list_contains(seen, dst) ORDER BY {d}, id LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT position, node_id, distance FROM w{k}" for k in range(hops + 1))
    return f"WITH {_SIM}, q AS (SELECT e AS v FROM v WHERE id = 8), {', '.join(steps)} SELECT position, node_id, round(distance, 6) + 0.0 AS distance FROM ({every})"


@query(_walk_sql(4))
def semantic_walk(spark, sf_dir):
    g = similar(spark, sf_dir)
    rows = vector.semantic_walk(g, 1, vector.embedding_of(g, 8), 4)
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(rows)], "position int, node_id long, distance double")


# --- changes

_NAMES = f"""names AS (SELECT {nid('Region', 'r_regionkey')} AS node_id, 'Region' AS labels, r_name AS name FROM region UNION ALL SELECT {nid('Nation', 'n_nationkey')}, 'Nation', n_name FROM nation
  UNION ALL SELECT {nid('Customer', 'c_custkey')}, 'Customer', c_name FROM customer UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'Supplier', s_name FROM supplier UNION ALL SELECT {nid('Part', 'p_partkey')}, 'Part', p_name FROM part
  UNION ALL SELECT {nid('Order', 'o_orderkey')}, 'Order', NULL FROM orders UNION ALL SELECT {nid('Vec', 'vec_id')}, 'Vec', NULL FROM embeddings
  UNION ALL SELECT CAST({KIND['EventType'] * BASE + 1} + i AS BIGINT), 'EventType', {list(EVENT_TYPES)}[i + 1] FROM range(5) t(i))"""
_NOT_AT_NATIONS = f"src NOT BETWEEN {KIND['Nation'] * BASE} AND {KIND['Nation'] * BASE + BASE - 1} AND dst NOT BETWEEN {KIND['Nation'] * BASE} AND {KIND['Nation'] * BASE + BASE - 1}"


@query(f"WITH {_E}, {_NODES} SELECT (SELECT count(*) FROM n WHERE label <> 'Nation') AS nodes, (SELECT count(*) FROM e WHERE {_NOT_AT_NATIONS}) AS edges")
def delete_by_label_counts(spark, sf_dir):
    g, _ = mutate.delete_by_label(star_graph(spark, sf_dir), "Nation")
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query(f"SELECT {nid('Nation', 'n_nationkey')} AS node_id, n_name AS name, CASE WHEN n_nationkey < 5 THEN 'yes' END AS flag FROM nation")
def update_merge(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    patches = read_table(spark, sf_dir, "nation").where("n_nationkey < 5").select(node_id("Nation", F.col("n_nationkey")).alias("id"), F.lit('{"flag": "yes"}').alias("patch"))
    n = mutate.update(g, patches).nodes.where(F.array_contains("labels", "Nation"))
    return n.select("node_id", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.flag").alias("flag"))


@query("SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def create_then_match(spark, sf_dir):
    """MATCH ... CREATE makes a REACHES edge back from each region to its nations."""
    g, _ = star_graph(spark, sf_dir).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (r)-[:REACHES]->(n)")
    return g.query("MATCH (r:Region)-[:REACHES]->(n:Nation) RETURN r.name AS name, count(*) AS n")


@query(f"SELECT {nid('Order', 'o_orderkey')} AS dst, CASE WHEN o_orderkey < 5 THEN 'yes' END AS flag, o_orderpriority AS priority FROM orders WHERE o_custkey < 50")
def update_edges(spark, sf_dir):
    """Patches for edges by their ids, and the edges of some customers afterwards."""
    patches = read_table(spark, sf_dir, "orders").where("o_orderkey < 5").select((F.lit(EDGE_TYPES.index("PLACED") << EDGE_BITS) + F.col("o_orderkey")).alias("id"), F.lit('{"flag": "yes"}').alias("patch"))
    g = mutate.update(star_graph(spark, sf_dir), patches, "edge")
    e = g.edges_of("PLACED").where(F.col("src") < CUSTOMER + 50)
    return e.select("dst", F.get_json_object("properties", "$.flag").alias("flag"), F.get_json_object("properties", "$.priority").alias("priority"))


@query(f"SELECT {nid('Customer', 'o_custkey')} AS src, {nid('Order', 'o_orderkey')} AS dst, 'PLACED' AS edge_type, o_totalprice AS weight FROM orders WHERE o_orderkey IN (7, 70) UNION ALL SELECT {nid('Nation', 'n_nationkey')}, {nid('Region', 'n_regionkey')}, 'IN_REGION', 1.0::DOUBLE FROM nation WHERE n_nationkey = 3")
def edge_lookup(spark, sf_dir):
    placed = EDGE_TYPES.index("PLACED") << EDGE_BITS
    return star_graph(spark, sf_dir).lookup_edges(placed + 7, placed + 70, 3).select("src", "dst", "edge_type", "weight")


@query("SELECT 'Dan' AS name, 'Eve' AS friend, 'KNOWS' AS type UNION ALL SELECT 'Fay', 'Eve', 'KNOWS'")
def create_return(spark, sf_dir):
    _, stats = star_graph(spark, sf_dir).query('CREATE (a:Person {name: "Dan"})-[e:KNOWS]->(b:Person {name: "Eve"}), (c:Person {name: "Fay"})-[f:KNOWS]->(b) RETURN a.name AS name, c.name AS other, b.name AS friend, type(e) AS type, type(f) AS second')
    return stats.rows.select("name", "friend", "type").union(stats.rows.select("other", "friend", "second"))


@query("SELECT r_name AS region, n_name AS nation, true AS made FROM region JOIN nation ON n_regionkey = r_regionkey")
def match_create_return(spark, sf_dir):
    _, stats = star_graph(spark, sf_dir).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (r)-[:REACHES]->(s:Stop {made: true})-[:AT]->(n) RETURN r.name AS region, n.name AS nation, s.made AS made")
    return stats.rows


@query(f"WITH {_NAMES} SELECT node_id, labels, name FROM names")
def export_nodes(spark, sf_dir):
    return io.export_nodes(star_graph(spark, sf_dir), ["name"])


@query(f"SELECT CAST({nid('Region', 'r_regionkey')} AS VARCHAR) AS node_id, r_name AS name FROM region")
def export_utf8(spark, sf_dir):
    return io.to_utf8(star_graph(spark, sf_dir).query("MATCH (r:Region) RETURN id(r) AS node_id, r.name AS name"))


_BOUNDS = [KIND["Customer"] * BASE, KIND["Part"] * BASE + 51, KIND["Order"] * BASE + 1_001]


@query(f"WITH {_NODES} SELECT node_id, CASE WHEN node_id < {_BOUNDS[0]} THEN 0 WHEN node_id < {_BOUNDS[1]} THEN 1 WHEN node_id < {_BOUNDS[2]} THEN 2 ELSE 3 END AS shard FROM n")
def range_partition(spark, sf_dir):
    return star_graph(spark, sf_dir).nodes.select("node_id").withColumn("shard", partition.range_shard(F.col("node_id"), _BOUNDS))


def _fnv_sql(node: str, shards: int) -> str:
    """FNV-1a over the eight bytes of an id, in 128-bit numbers."""
    h = f"{partition.FNV_OFFSET}::HUGEINT"
    for k in range(8):
        h = f"((xor({h}, (({node}::HUGEINT >> {8 * k}) & 255)) * {partition.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"({h} % {shards})::INT"


@query(f"WITH {_NODES} SELECT node_id, {_fnv_sql('node_id', 8)} AS shard FROM n")
def hash_partition(spark, sf_dir):
    return star_graph(spark, sf_dir).nodes.select("node_id").withColumn("shard", partition.hash_shard(F.col("node_id"), 8))


# --- text

_SUB = f"WITH RECURSIVE {_SIM}, r AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN sim ON src = n WHERE d < 2), b AS (SELECT n, min(d) AS d FROM r GROUP BY n ORDER BY d, n LIMIT 12), sub AS (SELECT src, dst, w FROM sim WHERE src IN (SELECT n FROM b) AND dst IN (SELECT n FROM b))"


@query(f"{_SUB} SELECT n AS node_id, d AS depth, row_number() OVER (ORDER BY d, n)::INT - 1 AS pos FROM b")
def subgraph_nodes(spark, sf_dir):
    return rag.extract_subgraph(similar(spark, sf_dir), 1, 2, 12).nodes.select("node_id", "depth", "pos")


@query(f"{_SUB} SELECT src, dst, round(w, 6) AS weight FROM sub")
def subgraph_edges(spark, sf_dir):
    return rag.extract_subgraph(similar(spark, sf_dir), 1, 2, 12).edges.select("src", "dst", "weight")


@query(f"{_SUB} SELECT '(n' || src || ', SIM, n' || dst || ')' AS line FROM sub")
def linearize_triples(spark, sf_dir):
    return rag.lines(rag.extract_subgraph(similar(spark, sf_dir), 1, 2, 12), "triples").select("line")


@query(f"""{_SUB}, p AS (SELECT n, 'Vec: n' || n AS head, ' (label: ' || label || ')' AS props FROM b JOIN embeddings ON vec_id + 1 = n)
SELECT 'Node [' || head || ']' || props AS line FROM p UNION ALL SELECT '  -[SIM]-> [' || head || ']' || props FROM sub JOIN p ON n = dst""")
def linearize_structured(spark, sf_dir):
    return rag.lines(rag.extract_subgraph(similar(spark, sf_dir), 1, 2, 12), "structured").select("line")


@query(f"""{_SUB}, p AS (SELECT n, 'n' || n AS name, ' (label: ' || label || ')' AS props FROM b JOIN embeddings ON vec_id + 1 = n)
SELECT name || ' is a Vec' || props || '.' AS line FROM p UNION ALL SELECT 'n' || src || ' SIM n' || dst || '.' FROM sub""")
def linearize_prose(spark, sf_dir):
    return rag.lines(rag.extract_subgraph(similar(spark, sf_dir), 1, 2, 12), "prose").select("line")


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", rag.estimate_tokens(F.col("text")).alias("tokens"))


@query()
def graph_rag(spark, sf_dir):
    g = similar(spark, sf_dir)
    a = rag.graph_rag(g, "what is near?", vector.embedding_of(g, 1), hops=2, max_nodes=16, budget=200)
    return spark.createDataFrame([(a.context, a.nodes, a.edges, a.tokens)], "context string, nodes int, edges int, tokens int")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_columns(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(b, F.col("vec_id") == F.col("a")).select("a", "b", D.euclidean(F.col("embedding"), F.col("other")).alias("euclidean"))


# --- graph neural networks

@query()
def gnn_train(spark, sf_dir):
    """Loss by epoch on the similarity graph."""
    g = similar(spark, sf_dir)
    labels = g.nodes.select("node_id", F.get_json_object("properties", "$.label").cast("int").alias("label"))
    m = gnn.train(gnn.gather(g, labels), gnn.Config(epochs=20))
    return spark.createDataFrame(list(enumerate(m.history)), "epoch int, loss double")


@query()
def gnn_predict(spark, sf_dir):
    g = similar(spark, sf_dir)
    labels = g.nodes.select("node_id", F.get_json_object("properties", "$.label").cast("int").alias("label"))
    m = gnn.train(gnn.gather(g, labels), gnn.Config(epochs=5))
    return gnn.predict_frame(m, g.nodes.select("node_id", F.col("embedding").alias("features")), g.edges)


# --- sources, sinks and the remaining operators

_ALL_NAMES = f"WITH {_NAMES} SELECT node_id, name FROM names"


def _cold(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> DataFrame:
    store = io.ColdStore(spark, f"{shared_dir(spark)}/cold-{uuid.uuid4().hex}", fmt)
    store.write("whole", star_graph(spark, sf_dir))
    out = cut(store.read("whole").nodes.select("node_id", F.get_json_object("properties", "$.name").alias("name")))
    store.delete("whole")
    remove_dir(spark, store.root)
    return out


@query(_ALL_NAMES)
def cold_parquet(spark, sf_dir):
    """Written to a partition of a Parquet store and read back."""
    return _cold(spark, sf_dir)


@query(_ALL_NAMES)
def cold_json(spark, sf_dir):
    return _cold(spark, sf_dir, "json")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_round_trip(spark, sf_dir):
    """Exported as JSON lines, imported, and queried."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    io.write_json(star_graph(spark, sf_dir), path)
    g, _ = io.read_json(spark, f"{path}/*", lines=True)
    out = cut(g.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region"))
    remove_dir(spark, path)
    return out


@query("SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ingest_frames(spark, sf_dir):
    """Frames told apart by their columns: labels for nodes, edge_type for edges."""
    n, s = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    nodes = n.select((F.col("n_nationkey") + 1).alias("id"), F.lit('["Nation"]').alias("labels"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("properties"))
    nodes = nodes.union(s.select(F.col("s_suppkey") + 1001, F.lit('["Supplier"]'), F.to_json(F.struct(F.col("s_name").alias("name")))))
    edges = s.select((F.col("s_suppkey") + 1001).alias("source"), (F.col("s_nationkey") + 1).alias("target"), F.lit("IN").alias("edge_type"), F.lit("{}").alias("properties"), F.lit(1.0).alias("weight"))
    g = io.ingest(io.ingest(io.empty(spark), nodes), edges)
    return g.query("MATCH (s:Supplier)-[:IN]->(n:Nation) RETURN s.name AS supplier, n.name AS nation")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL", 2)
def frame_import(spark, sf_dir):
    """A flat frame: its columns become properties, numbered in their order."""
    from graphspark.graph import EDGES

    nodes = io.nodes_from_frame(read_table(spark, sf_dir, "customer"), "Customer")
    g = PropertyGraph.of(nodes, spark.createDataFrame([], EDGES))
    return g.query("MATCH (c:Customer) RETURN c.c_mktsegment AS segment, count(*) AS n, sum(c.c_acctbal) AS total")


_TYPED = f"""t AS (SELECT {nid('Nation', 'n_nationkey')} AS source, {nid('Region', 'n_regionkey')} AS target, 'IN_REGION' AS edge_type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT {nid('Customer', 'c_custkey')}, {nid('Nation', 'c_nationkey')}, 'CUSTOMER_IN', 1.0 FROM customer UNION ALL SELECT {nid('Supplier', 's_suppkey')}, {nid('Nation', 's_nationkey')}, 'SUPPLIER_IN', 1.0 FROM supplier
  UNION ALL SELECT {nid('Customer', 'o_custkey')}, {nid('Order', 'o_orderkey')}, 'PLACED', o_totalprice FROM orders
  UNION ALL SELECT {nid('Order', 'l_orderkey')}, {nid('Part', 'l_partkey')}, 'CONTAINS', l_quantity FROM lineitem UNION ALL SELECT {nid('Part', 'l_partkey')}, {nid('Supplier', 'l_suppkey')}, 'SUPPLIED_BY', l_quantity FROM lineitem
  UNION ALL SELECT {nid('Customer', 'user_id')}, CAST({KIND['EventType'] * BASE} + list_position({list(EVENT_TYPES)}, event_type) AS BIGINT), 'DID', 1.0 FROM events)"""


@query(f"WITH {_TYPED} SELECT * FROM t")
def export_edges(spark, sf_dir):
    return io.export_edges(star_graph(spark, sf_dir)).drop("edge_id")


@query(f"WITH RECURSIVE {_BFS}, {_NAMES}, b AS (SELECT n AS node_id, min(d) AS depth FROM r GROUP BY n) SELECT node_id, depth, labels, name FROM b LEFT JOIN names USING (node_id)")
def export_bfs(spark, sf_dir):
    return io.export_bfs(star_graph(spark, sf_dir), CUSTOMER, 3, keys=["name"])


@query(f"WITH {_E}, {_NODES} SELECT (SELECT count(*) FROM e WHERE src <> {NATION} AND dst <> {NATION}) AS edges, (SELECT count(*) FROM n WHERE label = 'Nation') - 1 AS nations")
def delete_node(spark, sf_dir):
    g = mutate.delete_nodes(star_graph(spark, sf_dir), spark.range(NATION, NATION + 1).select(F.col("id").alias("node_id")))
    return g.edges.agg(F.count("*").alias("edges")).crossJoin(g.nodes.where(F.array_contains("labels", "Nation")).agg(F.count("*").alias("nations")))


@query(f"WITH {_TYPED} SELECT edge_type, count(*) AS n FROM t WHERE edge_type <> 'IN_REGION' GROUP BY ALL")
def delete_edges(spark, sf_dir):
    g, _ = star_graph(spark, sf_dir).query("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) DELETE e")
    return g.edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT c_name AS name, o_orderkey::BIGINT AS orderkey, 'yes' AS big FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def set_property(spark, sf_dir):
    g, _ = star_graph(spark, sf_dir).query('MATCH (o:Order) WHERE o.totalprice > 400000 SET o.big = "yes"')
    return g.query('MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.big = "yes" RETURN c.name AS name, o.orderkey AS orderkey, o.big AS big')


@query(f"WITH {_NODES} SELECT 'Eve' AS name, 'Dan' AS friend, (SELECT count(*) FROM n) + 2 AS nodes")
def create_batch(spark, sf_dir):
    g, ids = mutate.create_nodes(star_graph(spark, sf_dir), [{"labels": ["Person"], "properties": {"name": "Dan"}}, {"labels": ["Person"], "properties": {"name": "Eve"}}])
    g, _ = mutate.create_edges(g, [{"src": ids[1], "dst": ids[0], "type": "KNOWS"}])
    found = g.query("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.name AS name, b.name AS friend")
    return found.crossJoin(g.nodes.agg(F.count("*").alias("nodes")))


@query(f"WITH RECURSIVE {_E}, r AS (SELECT CAST({CUSTOMER} AS BIGINT) AS n, 0 AS d UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = n WHERE d < 2) SELECT n AS node_id, min(d) AS depth FROM r GROUP BY n")
def call_bfs(spark, sf_dir):
    return star_graph(spark, sf_dir).query(f"CALL algo.bfs({CUSTOMER}, 2)")


@query(f"""WITH RECURSIVE {_EV}, u AS (SELECT src AS a, dst AS b FROM ev WHERE {_AT.format(t=T1)} UNION SELECT dst, src FROM ev WHERE {_AT.format(t=T1)}),
r AS (SELECT CAST({CUSTOMER} AS BIGINT) AS n, 0 AS d UNION SELECT b, d + 1 FROM r JOIN u ON a = n WHERE d < 6) SELECT n AS node_id, min(d)::DOUBLE AS cost FROM r GROUP BY n""")
def shortest_paths_at(spark, sf_dir):
    """Hops over the events valid at a moment, both ways; customers and event types are at most four apart."""
    g = star_graph(spark, sf_dir).only("DID").at(T1)
    return traverse.sssp(g, CUSTOMER, weighted=False, direction="both").select("node_id", "cost")


@query(f"SELECT {nid('Nation', 'n_nationkey')} AS node_id FROM nation")
def sealed_search(spark, sf_dir):
    key = b"a key of the owner"
    return sealed.search(sealed.seal(star_graph(spark, sf_dir).nodes, key), sealed.tag(key, "Nation")).select("node_id")


@query(f"WITH {_E} SELECT {_fnv_sql('src', 16)} AS shard, count(*) AS n FROM e GROUP BY ALL")
def edge_shards(spark, sf_dir):
    return partition.edge_shards(star_graph(spark, sf_dir).edges, 16).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_SIM}, r AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN sim ON src = n WHERE d < 3), b AS (SELECT n, min(d) AS d FROM r GROUP BY n),
p AS (SELECT n, row_number() OVER (ORDER BY d, n) - 1 AS pos, '[Vec: n' || n || '] (label: ' || label || ')' AS shown FROM b JOIN embeddings ON vec_id + 1 = n),
z AS (SELECT pos, strlen('Node ' || shown) + 1 AS bytes FROM p UNION ALL SELECT greatest(a.pos, c.pos), strlen('  -[SIM]-> ' || c.shown) + 1 FROM sim JOIN p a ON a.n = src JOIN p c ON c.n = dst),
t AS (SELECT pos, sum(sum(bytes)) OVER (ORDER BY pos) AS total FROM z GROUP BY pos), over AS (SELECT min(pos) AS pos FROM t WHERE ceil((total - 1) / 4) > 300)
SELECT n AS node_id, p.pos::INT AS pos FROM p, over WHERE p.pos < greatest(1, coalesce(over.pos, 1000000))""")
def budget_subgraph(spark, sf_dir):
    return rag.extract_with_budget(similar(spark, sf_dir), 1, 3, 300).nodes.select("node_id", "pos")


@query(r"SELECT doc_id, 64 AS dimension, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::DOUBLE AS words FROM documents")
def embed_text(spark, sf_dir):
    """Counts of hashed words: their sum is the number of words."""
    docs = rag.embed(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", rag.hash_embedder(64))
    return docs.select("doc_id", F.size("embedding").alias("dimension"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("words"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT epoch_us(s) // 1000 AS start, event_type, n, round(total, 4) AS total FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", 4)
def stream_counts(spark, sf_dir):
    """Windows of an event stream that its watermark has closed, from one run over what is there."""
    from graphspark.streaming.events import SCHEMA, windowed_counts

    name = f"counts_{uuid.uuid4().hex}"
    events = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    running = windowed_counts(events).writeStream.outputMode("append").format("memory").queryName(name).start()
    running.processAllAvailable()
    running.stop()
    return spark.table(name).select(F.unix_millis("start").alias("start"), "event_type", "n", "total")
