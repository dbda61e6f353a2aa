import pytest

from graphspark.errors import AnalysisError, ParseError
from graphspark.plans.syntax import parse


def rows(g, text, **how):
    return [tuple(r) for r in g.query(text, **how).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("MATCH (x) RETURN count(*) AS every", [(4,)]),
        ("MATCH (p:Port) RETURN count(p)", [(3,)]),
        ("MATCH (f:Ship:Ferry) RETURN f.name", [("Marlin",)]),
        ("MATCH (a:Port)-[:ROUTE]->(b:Port) RETURN a.name, b.name ORDER BY a.name, b.name", [("Lisbon", "Genoa"), ("Oslo", "Genoa"), ("Oslo", "Lisbon")]),
        ("MATCH (p:Port) WHERE p.berths > 27 RETURN p.name", [("Oslo",)]),
        ("MATCH (p:Port) WHERE p.berths >= 12 AND p.berths < 40 RETURN p.name ORDER BY p.name", [("Genoa",), ("Lisbon",)]),
        ("MATCH (p:Port) RETURN p.berths ORDER BY p.berths DESC", [(40,), (27,), (12,)]),
        ("MATCH (p:Port) RETURN p.name ORDER BY p.name SKIP 2 LIMIT 5", [("Oslo",)]),
        ("MATCH (p:Port) RETURN DISTINCT labels(p) AS kinds", [(["Port"],)]),
        ("MATCH (t:Train) RETURN count(*)", [(0,)]),
        ("MATCH (x) WHERE x.berths < 20 RETURN x.name ORDER BY x.name", [("Lisbon",), ("Marlin",)]),
        ("MATCH (x) WHERE x.berths <> 40 RETURN count(*)", [(3,)]),
        ("MATCH (x) WHERE NOT x.berths RETURN x.name", [("Marlin",)]),
        ("MATCH (x) WHERE x.berths RETURN x.name", []),
        ("MATCH (s:Ship) RETURN s.length / 10, s.length % 10, 7 / 0, s.length / 0", [(15, 5, None, None)]),
        ('MATCH (s:Ship) RETURN "MS " + s.name, "MS " - s.name, -s.length, s.name * 2', [("MS Marlin", None, -155, None)]),
        ('MATCH (s:Ship) RETURN toString(s.crew), toInteger("81"), toInteger(" 8"), toInteger("8.1"), toInteger(8.9), toFloat("2.25"), toBoolean("False")', [("null", 81, None, None, 8, 2.25, False)]),
        ("MATCH (x {berths: 12}) RETURN x.name", [("Lisbon",)]),
        ("MATCH (x {berths: 12.0}) RETURN x.name", []),
        ("MATCH (a)-[r {days: 9}]->(b) RETURN a.name, type(r), r.days, r.weight", [("Oslo", "ROUTE", 9, 7.0)]),
        ('MATCH (a {name: "Lisbon"})-[r]-(b) RETURN b.name ORDER BY b.name', [("Genoa",), ("Marlin",), ("Oslo",)]),
        ('MATCH (a {name: "Lisbon"})-->(b)<--(c) RETURN b.name, c.name ORDER BY c.name', [("Genoa", "Lisbon"), ("Genoa", "Oslo")]),
        ("MATCH (a)-[r:ROUTE:MOORED_AT]->(b) RETURN count(*)", [(4,)]),
        ("MATCH (a:Ship)-[*1..2]->(b) RETURN a.name, b.name ORDER BY b.name", [("Marlin", "Genoa"), ("Marlin", "Lisbon")]),
        ("MATCH (p:Port) WHERE NOT (p)<-[:MOORED_AT]-(s) RETURN p.name ORDER BY p.name", [("Genoa",), ("Oslo",)]),
        ("MATCH (p:Port) WHERE (p)<-[:MOORED_AT]-(s:Ship) RETURN p.name", [("Lisbon",)]),
        ("MATCH (p)-[:ROUTE]->(q) MATCH (s)-[:MOORED_AT]->(p) RETURN q.name, s.name", [("Genoa", "Marlin")]),
        ("MATCH (a)-[:ROUTE]->(b)-[:ROUTE]->(a) RETURN count(*)", [(0,)]),
        ("MATCH (s:Ship), (p:Port) RETURN count(*)", [(3,)]),
        ("MATCH (p:Port) RETURN sum(p.berths) AS s, avg(p.berths) AS a, min(p.berths) AS lo, max(p.berths) AS hi, collect(p.name) AS c", [(79, pytest.approx(79 / 3), 12, 40, ["Genoa", "Lisbon", "Oslo"])]),
        ("MATCH (p:Port) RETURN count(*) * 2 AS n", [(6,)]),
        ('MATCH (x) WHERE x.name STARTS WITH "M" OR x.name CONTAINS "no" RETURN x.name ORDER BY x.name', [("Genoa",), ("Marlin",)]),
        ("MATCH (x) WHERE x.berths IN [27, 40] RETURN count(*)", [(2,)]),
        ("MATCH (x) WHERE x.berths IS NULL RETURN x.name // trailing words", [("Marlin",)]),
        ("MATCH (p:Port) RETURN p.berths AS b ORDER BY b LIMIT 1", [(12,)]),
        ("MATCH (p:Port) WHERE p.depth = null RETURN count(*)", [(3,)]),
    ],
)
def test_reads(harbours, text, expected):
    assert rows(harbours, text) == expected


def test_whole_objects(harbours):
    import json

    ((text,),) = rows(harbours, "MATCH (s:Ship) RETURN s")
    assert json.loads(text) == {"id": 24, "labels": ["Ship", "Ferry"], "properties": {"name": "Marlin", "length": 155}}
    ((text,),) = rows(harbours, "MATCH (a)-[m:MOORED_AT]->(b) RETURN m")
    assert json.loads(text) == {"id": 8, "source": 24, "target": 22, "edge_type": "MOORED_AT", "properties": {}, "weight": 1.0}


def test_compat_aggregates(harbours):
    ((n, total),) = rows(harbours, "MATCH (p:Port) RETURN count(*), sum(p.berths)", compat=True)
    assert (n, total) == (3, None)


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "MATCH (n) RETURN n extra words", "MATCH (n)", "MATCH (a)<-[r]->(b) RETURN a", "RETURN 1", "MATCH (n) RETURN n.order", "MATCH (n) WHERE n.x ! 1 RETURN n"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["MATCH (p) RETURN depth(p.name)", "MATCH (p) RETURN q.name", "MATCH (p) DELETE q", "CALL nowhere.at_all()"])
def test_analysis_errors(harbours, text):
    with pytest.raises(AnalysisError):
        harbours.query(text).collect()


def test_registered_function(harbours):
    from pyspark.sql import functions as F

    g = harbours.register_function("loud", lambda c: F.upper(c))
    assert rows(g, "MATCH (s:Ship) RETURN loud(s.name)") == [("MARLIN",)]


def test_writes(harbours):
    g, stats = harbours.query('CREATE (a:Port {name: "Bergen", berths: 60})-[:ROUTE]->(b:Port {name: "Malmo"})')
    assert (stats.nodes_created, stats.edges_created) == (2, 1)
    assert rows(g, 'MATCH (a {name: "Bergen"})-[:ROUTE]->(b) RETURN b.name') == [("Malmo",)]
    g, stats = g.query("MATCH (p:Port) WHERE p.berths > 30 SET p.large = true, p.berths = p.berths - 1")
    assert stats.properties_set == 4
    assert rows(g, "MATCH (p) WHERE p.large = true RETURN p.name, p.berths ORDER BY p.name") == [("Bergen", 59), ("Oslo", 39)]
    g, stats = g.query('MATCH (p {name: "Lisbon"}) DELETE p')
    assert (stats.nodes_deleted, stats.edges_deleted) == (1, 3)
    assert rows(g, "MATCH (a)-[:ROUTE]->(b) RETURN a.name, b.name ORDER BY a.name") == [("Bergen", "Malmo"), ("Oslo", "Genoa")]
    g, stats = g.query("MATCH (a)-[r:ROUTE {days: 9}]->(b) DELETE r")
    assert stats.edges_deleted == 1


def test_create_returns(harbours):
    _, stats = harbours.query('CREATE (a:Port {name: "Turku"})-[r:ROUTE]->(b:Port) RETURN a.name, type(r), b.name')
    assert [tuple(r) for r in stats.rows.collect()] == [("Turku", "ROUTE", None)]
    _, stats = harbours.query("MATCH (p:Port)-[e:ROUTE]->(q) CREATE (q)-[:BACK]->(s:Stop {n: 1}) RETURN p.name AS a, e.days AS d, s.n AS n ORDER BY d")
    assert [tuple(r) for r in stats.rows.collect()] == [("Lisbon", 4, 1), ("Oslo", 6, 1), ("Oslo", 9, 1)]


def test_create_returns_from_what_it_made(spark):
    """No product of the tables' partitions, and none of the other tables is read for the rows returned."""
    from graphspark.tables import star_graph

    asked = 'CREATE (a:Person {name: "Dan"})-[e:KNOWS]->(b:Person {name: "Eve"}), (c:Person {name: "Fay"})-[f:KNOWS]->(b) RETURN a.name, type(e), b.name, c.name, type(f), a.acctbal'
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, stats = star_graph(spark, "/root/testdata/sf0.001").query(asked)
        plan = stats.rows._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and not stats.rows.inputFiles()
        assert [tuple(r) for r in stats.rows.collect()] == [("Dan", "KNOWS", "Eve", "Fay", "KNOWS", None)]
        assert stats.rows.dtypes[-1][1] == "double"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changes_keep_typed_tables(spark):
    """No pass over the whole graph for the types of its properties, and filters still reach the scans."""
    from graphspark.graph import CHANGES
    from graphspark.operators import mutate
    from graphspark.tables import star_graph

    g = star_graph(spark, "/root/testdata/sf0.001")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("changes", "")
    for k in range(CHANGES + 2):
        g, _ = mutate.create_nodes(g, [{"labels": ["Person"], "properties": {"name": f"p{k}"}}])
    jobs = len(tracker.getJobIdsForGroup("changes"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(t.change for t in g.node_tables) <= CHANGES and jobs <= 12 * (CHANGES + 2)
    plan = g.query('MATCH (c:Customer) WHERE c.mktsegment = "BUILDING" RETURN c.name')._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert g.query("MATCH (p:Person) RETURN p.name AS n ORDER BY n").count() == CHANGES + 2


def test_filters_reach_the_scan(spark):
    from graphspark.tables import star_graph

    df = star_graph(spark, "/root/testdata/sf0.001").query('MATCH (c:Customer) WHERE c.mktsegment = "BUILDING" AND c.acctbal > 0 RETURN c.name')
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "GreaterThan(c_acctbal" in plan
    assert "ReadSchema: struct<c_name:string,c_acctbal:double,c_mktsegment:string>" in plan


def test_declared_ends_need_no_join(spark):
    from graphspark.tables import star_graph

    df = star_graph(spark, "/root/testdata/sf0.001").query("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name, id(o)")
    assert "orders.parquet" in df.inputFiles()[0] + df.inputFiles()[-1]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_lookups_read_what_they_need(spark):
    from graphspark.operators import traverse
    from graphspark.tables import BASE, KIND, star_graph

    g = star_graph(spark, "/root/testdata/sf0.001")
    files = lambda df: {f.rsplit("/", 1)[-1].removesuffix(".parquet") for f in df.inputFiles()}
    nation = KIND["Nation"] * BASE + 4
    near = traverse.neighbors(g, nation, "both")
    assert files(near) == {"nation", "customer", "supplier"} and "EqualTo(n_nationkey,3)" in near._jdf.queryExecution().toString()
    node = g.lookup(KIND["Supplier"] * BASE + 8)
    assert files(node) == {"supplier"} and "EqualTo(s_suppkey,7)" in node._jdf.queryExecution().toString()
    assert g.lookup(5).count() == 0 and g.touching("src", [5]).count() == 0
    ids = [r[0] for r in g.edges.select("edge_id").limit(3).collect()]
    assert g.lookup_edges(*ids).count() >= 3
