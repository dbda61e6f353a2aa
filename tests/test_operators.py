import random

import pytest
from pyspark.sql import functions as F

from graphspark.errors import DimensionMismatch, DuplicateNode, NodeNotFound
from graphspark.functions import distance as D
from graphspark.operators import algorithms as A
from graphspark.operators import gnn, linalg, mutate, partition, rag, sealed, traverse, vector
from graphspark.operators.components import connected_components
from graphspark.operators.ranking import global_rank
from graphspark.sources import io


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.fixture(scope="module")
def diamond(make_graph):
    return make_graph([11, 12, 13, 14, 15], [(11, 12, 4), (11, 13, 1), (13, 12, 2), (12, 14, 1), (13, 14, 6), (14, 15, 3)])


@pytest.fixture(scope="module")
def timed(make_graph):
    return make_graph([31, 32, 33], [(31, 32, 1, 10, 40), (32, 33, 1, 20, None), (31, 33, 9, None, 15)])


def test_bfs_dfs(spark, diamond):
    assert pairs(traverse.bfs(diamond, 11, 0), "node_id", "depth") == {(11, 0)}
    assert pairs(traverse.bfs(diamond, 11, 9), "node_id", "depth") == {(11, 0), (12, 1), (13, 1), (14, 2), (15, 3)}
    assert pairs(traverse.bfs(diamond, 14, 2, "incoming"), "node_id", "depth") == {(14, 0), (12, 1), (13, 1), (11, 2)}
    assert pairs(traverse.bfs(diamond, 77, 3), "node_id", "depth") == {(77, 0)}
    both = spark.createDataFrame([(12,), (15,)], "node_id long")
    assert pairs(traverse.bfs(diamond, both, 1, "both"), "node_id", "depth") == {(12, 0), (15, 0), (11, 1), (13, 1), (14, 1)}
    assert traverse.dfs(diamond, 11, 9) == [11, 12, 14, 15, 13]
    assert traverse.dfs(diamond, 11, 0) == [11]
    assert {r["level"] for r in traverse.bfs_levels(diamond, 15).collect()} == {0, -1}


@pytest.mark.parametrize("small", [0, 1000])
def test_sssp(diamond, small):
    got = {r["node_id"]: r["cost"] for r in traverse.sssp(diamond, 11, small=small, all_nodes=True).collect()}
    assert got == {11: 0.0, 12: 3.0, 13: 1.0, 14: 4.0, 15: 7.0}
    assert traverse.sssp(diamond, 15, small=small, all_nodes=True).where("cost = double('inf')").count() == 4
    got = {r["node_id"]: r["cost"] for r in traverse.sssp(diamond, 11, small=small, max_hops=1).collect()}
    assert got == {11: 0.0, 12: 4.0, 13: 1.0}


def test_negative_weights(make_graph):
    with pytest.raises(ValueError):
        traverse.sssp(make_graph([1, 2], [(1, 2, -1)]), 1)


def test_shortest_path(make_graph, diamond):
    p = traverse.shortest_path(diamond, 11, 14, weighted=True)
    assert p.nodes() == [11, 13, 12, 14] and p.cost == 4.0
    assert len(traverse.shortest_path(diamond, 11, 14)) == 2
    assert traverse.shortest_path(diamond, 15, 11) is None
    assert len(traverse.shortest_path(diamond, 12, 12)) == 0
    line = make_graph(list(range(30)), [(i, i + 1, 1) for i in range(29)])
    assert traverse.shortest_path(line, 0, 29).nodes() == list(range(30))


@pytest.mark.parametrize("t, reach", [(5, {31, 33}), (12, {31, 32, 33}), (17, {31, 32}), (30, {31, 32, 33}), (99, {31})])
def test_valid_time(timed, t, reach):
    assert {r["node_id"] for r in traverse.bfs(timed.at(t), 31, 3).collect()} == reach


def test_temporal_diff(timed):
    assert pairs(traverse.temporal_diff(timed, 31, 5, 12), "node_id", "status") == {(32, "added"), (33, "kept")}
    assert pairs(traverse.temporal_diff(timed, 31, 12, 30), "node_id", "status") == {(32, "kept"), (33, "removed")}


def test_asof_edges(spark):
    """Against all pairs: closed spans of any length, open ends, empty spans, nulls."""
    rng = random.Random(5)
    at = [rng.randrange(0, 10**9) for _ in range(60)] + [None, 0]
    events = spark.createDataFrame([(i, rng.choice([1, 2, None]), t) for i, t in enumerate(at)], "event long, user long, at long")
    spans = [(None, None), (0, None), (None, 10**8), (5, 5), (9, 3), (0, 10**9), (0, 1)]
    spans += [(a, a + rng.choice([1, 1000, 60_000, 10**6, 10**8, 5 * 10**8])) for a in (rng.randrange(0, 10**9) for _ in range(80))]
    edges = spark.createDataFrame([(k, rng.choice([1, 2, None]), a, b) for k, (a, b) in enumerate(spans)], "edge long, user long, valid_from long, valid_to long")
    want = {(e["event"], s["edge"]) for e in events.collect() for s in edges.collect() if e["at"] is not None and e["user"] is not None and e["user"] == s["user"] and (s["valid_from"] is None or s["valid_from"] <= e["at"]) and (s["valid_to"] is None or e["at"] < s["valid_to"])}
    got = [tuple(r) for r in traverse.asof_edges(events, edges, "user", "at").select("event", "edge").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert traverse.asof_edges(events, edges.limit(0), "user", "at").count() == 0


def test_self_loops_and_directions(make_graph):
    g = make_graph([1, 2], [(1, 1, 1), (1, 2, 1), (1, 2, 1)])
    assert traverse.neighbors(g, 1, "both").count() == 3
    assert traverse.neighbors(g, 2, "incoming").count() == 2
    with pytest.raises(ValueError):
        traverse.neighbors(g, 1, "sideways")


def ranks(g, **how):
    return {r["node_id"]: r["rank"] for r in A.pagerank(g.nodes, g.edges, **how).collect()}


def test_pagerank(make_graph):
    r = ranks(make_graph([1, 2, 3], [(1, 2, 1), (2, 3, 1), (3, 1, 1)]))
    assert all(abs(v - 1 / 3) < 1e-6 for v in r.values())
    r = ranks(make_graph([1, 2, 3, 4], [(1, 2, 1), (1, 3, 1), (1, 4, 1)]))
    assert abs(sum(r.values()) - 1) < 1e-6 and r[2] == pytest.approx(r[4])
    r = ranks(make_graph([1, 2, 3, 4, 5], [(2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (1, 2, 1)]))
    assert max(r, key=r.get) == 1


@pytest.mark.parametrize("small", [0, 1000])
def test_components(make_graph, small):
    g = make_graph([1, 2, 3, 4, 5], [(1, 2, 1), (2, 3, 1), (4, 5, 1)])
    assert pairs(A.wcc(g.nodes, g.edges), "node_id", "component") == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert pairs(A.scc(g.nodes, g.edges, small=small), "node_id", "component") == {(i, i) for i in range(1, 6)}
    g = make_graph([1, 2, 3, 4], [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1)])
    assert pairs(A.scc(g.nodes, g.edges, small=small), "node_id", "component") == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_strong_chains(make_graph):
    """Long chains are jumped along, and nothing is left out."""
    n = 500
    g = make_graph(list(range(n)), [(i, i + 1, 1) for i in range(n - 1)])
    got = pairs(A.scc(g.nodes, g.edges, small=0), "node_id", "component")
    assert got == {(i, i) for i in range(n)}
    ring = make_graph(list(range(200)), [(i, (i + 1) % 150, 1) for i in range(150)] + [(149 + i, 150 + i, 1) for i in range(50)])
    got = pairs(A.scc(ring.nodes, ring.edges, small=0), "node_id", "component")
    assert got == {(i, 0 if i < 150 else i) for i in range(200)}


def test_strong_rings_in_a_row(spark, make_graph):
    """Rounds count by the logarithm of how many components lie in a row, and what hangs between them is told apart."""
    n = 600
    g = make_graph(list(range(n)), [(i, i + 1, 1) for i in range(n - 1)] + [(i + 4, i, 1) for i in range(0, n, 15)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rings", "")
    got = pairs(A.scc(g.nodes, g.edges, small=0), "node_id", "component")
    jobs = len(tracker.getJobIdsForGroup("rings"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(i, i - i % 15 if i % 15 < 5 else i) for i in range(n)}
    assert jobs < 400


def test_strong_shapes(make_graph):
    ring = lambda *x: [(a, b, 1) for a, b in zip(x, (*x[1:], x[0]), strict=True)]
    whole = lambda *x: [(a, b, 1) for a in x for b in x if a != b]
    e = ring(5, 3, 8) + [(8, 11, 1), (11, 12, 1), (12, 13, 1), (12, 14, 1), (14, 3, 1), (13, 15, 1)]  # a branch that comes back, another that doesn't
    e += ring(20, 21) + ring(22, 23) + [(20, 22, 1), (15, 20, 1)] + ring(30, 31) + ring(32, 33, 34) + [(30, 33, 1), (34, 31, 1)]
    e += ring(40, 41, 42) + [(50, 51, 1), (51, 41, 1), (52, 51, 1)] + whole(60, 61, 62, 63) + whole(70, 71, 72, 73) + [(63, 70, 1), (62, 71, 1), (63, 80, 1), (80, 81, 1), (81, 72, 1)]
    e += whole(1, 91, 92, 93) + [(93, 94, 1), (94, 95, 1), (95, 92, 1), (94, 96, 1), (0, 1, 1), (7, 7, 1), (7, 999, 1)]
    ids = sorted({x for a, b, _ in e for x in (a, b)} - {999} | {100})
    g = make_graph(ids, e)
    got = pairs(A.scc(g.nodes, g.edges, small=0), "node_id", "component")
    assert got == pairs(A.scc(g.nodes, g.edges), "node_id", "component")
    assert {(11, 3), (14, 3), (13, 13), (33, 30), (22, 22), (80, 80), (95, 1), (96, 96), (100, 100)} <= got


def test_strong_random(spark, make_graph):
    rng = random.Random(9)
    g = make_graph(list(range(60)), [(rng.randrange(60), rng.randrange(60), 1) for _ in range(75)])
    assert pairs(A.scc(g.nodes, g.edges, small=0), "node_id", "component") == pairs(A.scc(g.nodes, g.edges), "node_id", "component")


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = dict(pairs(connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component"))
    assert got == {x: label[x] for x in label if any(a != b and x in (a, b) for a, b in edges)}


def test_centrality(make_graph):
    star = make_graph([1, 2, 3, 4, 5], [e for i in range(2, 6) for e in ((1, i, 1), (i, 1, 1))])
    out = dict(pairs(A.degree_centrality(star.nodes, star.edges), "node_id", "centrality"))
    assert out[1] == 1.0 and out[2] == 0.25
    assert dict(pairs(A.degree_centrality(star.nodes, star.edges, "both"), "node_id", "centrality"))[1] == 2.0
    path = make_graph([1, 2, 3, 4], [(1, 2, 1), (2, 3, 1), (3, 4, 1)])
    b = dict(pairs(A.betweenness(path.nodes, path.edges), "node_id", "centrality"))
    assert b[2] == pytest.approx(2 / 6) and b[3] == pytest.approx(2 / 6) and b[1] == b[4] == 0
    two = make_graph([1, 2], [(1, 2, 1)])
    assert {r["centrality"] for r in A.betweenness(two.nodes, two.edges).collect()} == {0.0}


@pytest.mark.parametrize("form", [A.louvain, A.louvain_exact])
def test_louvain(make_graph, form):
    tri = lambda a, b, c: [(x, y, 1) for x in (a, b, c) for y in (a, b, c) if x != y]
    g = make_graph([1, 2, 3, 4, 5, 6], [*tri(1, 2, 3), *tri(4, 5, 6), (3, 4, 0.1), (4, 3, 0.1)])
    c = form(g.nodes, g.edges)
    got = dict(pairs(c, "node_id", "community"))
    assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1 and got[1] != got[4]
    assert A.modularity(c, g.edges).first()[0] > 0.4
    empty = make_graph([1, 2], [(1, 1, 1)])
    assert form(empty.nodes, empty.edges.limit(0)).select("community").distinct().count() == 2


def test_global_rank(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("x")).repartition(7)
    assert [r["rank"] for r in global_rank(df, [F.col("x")]).orderBy("x").collect()] == list(range(1, 101))
    assert global_rank(df.limit(0), [F.col("x")]).count() == 0


@pytest.mark.parametrize("a, b, cosine", [([1.0, 0.0], [2.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 2.0), ([0.0, 0.0], [1.0, 0.0], 1.0)])
def test_distances(spark, a, b, cosine):
    r = spark.range(1).select(D.cosine(D.vector(a), D.vector(b)), D.euclidean(D.vector(a), D.vector(a)), D.dot_distance(D.vector(a), D.vector(a))).first()
    assert r[0] == pytest.approx(cosine) and r[1] == 0 and r[2] == -sum(x * x for x in a)


@pytest.fixture(scope="module")
def things(make_graph):
    vectors = {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [0.9, 0.1, 0.0], 4: [0.1, 0.9, 0.0], 5: [0.0, 0.0, 1.0]}
    return make_graph([1, 2, 3, 4, 5], [(1, 3, 1), (1, 4, 1), (3, 5, 1), (2, 4, 1), (4, 5, 1)], vectors)


def test_semantic(things):
    ids = lambda df: [r["node_id"] for r in df.collect()]
    assert ids(vector.hybrid_search(things, 1, [1.0, 0.0, 0.0], 2, 10, 1.0, "euclidean")) == [3, 4, 5]
    assert ids(vector.hybrid_search(things, 1, [0.1, 0.9, 0.0], 1, 10, 0.5, "euclidean")) == [4, 3]
    assert ids(vector.semantic_neighbors(things, 1, [1.0, 0.0, 0.0], 10, metric="euclidean")) == [3, 4]
    walk = vector.semantic_walk(things, 1, [0.0, 0.0, 1.0], 3, "euclidean")
    assert len(walk) == 3 and walk[-1][0] == 5 and walk[-1][1] < 1e-6
    assert len(vector.semantic_walk(things, 5, [0.0, 0.0, 1.0], 3, "euclidean")) == 1
    assert ids(vector.knn(things.nodes, [1.0, 0.0, 0.0], 100)) == [1, 3, 4, 2, 5]
    join = vector.knn_join(things.nodes, things.nodes, 1, "euclidean").orderBy("query_id").collect()
    assert [(r["query_id"], r["node_id"]) for r in join][:4] == [(1, 3), (2, 4), (3, 1), (4, 2)]


def test_mutations(spark, make_graph):
    g = make_graph([1, 2], [(1, 2, 1)], {1: [1.0, 0.0]})
    g2, ids = mutate.create_nodes(g, [{"labels": ["X"], "properties": {"a": 1}}, {"id": 9}])
    assert ids == [10, 9] and g2.nodes.count() == 4 and g.nodes.count() == 2
    with pytest.raises(DuplicateNode):
        mutate.create_nodes(g, [{"id": 1}])
    with pytest.raises(DimensionMismatch):
        mutate.create_nodes(g, [{"embedding": [1.0, 2.0, 3.0]}])
    with pytest.raises(NodeNotFound):
        mutate.create_edges(g, [{"src": 1, "dst": 77}])
    g3 = mutate.update(g2, spark.createDataFrame([(10, '{"b": [1], "a": null}'), (9, "7")], "id long, patch string"))
    import json

    assert {i: json.loads(p) for i, p in pairs(g3.nodes.where("node_id >= 9"), "node_id", "properties")} == {10: {"a": None, "b": [1]}, 9: 7}
    gone, n = mutate.delete_by_label(g2, "Thing")
    assert n == 2 and gone.edges.count() == 0 and gone.nodes.count() == 2


def test_text(make_graph, harbours):
    import json

    s = rag.extract_subgraph(harbours, 21, 2, 100)
    assert rag.linearize(s, "triples").split("\n") == ["(Oslo, ROUTE, Genoa)", "(Oslo, ROUTE, Lisbon)", "(Lisbon, ROUTE, Genoa)"]
    text = rag.linearize(s)
    assert "Node [Port: Oslo] (berths: 40)" in text and "  -[ROUTE {days: 4}]-> [Port: Genoa] (berths: 27)" in text
    assert "Oslo ROUTE Lisbon {days: 6}." in rag.linearize(s, "prose")
    assert len(json.loads(rag.linearize(s, "json"))["edges"]) == 3
    assert rag.extract_subgraph(harbours, 21, 2, 2).nodes.count() == 2
    for budget in (1, 20, 40, 1000):
        some = rag.extract_with_budget(harbours, 21, 2, budget)
        assert some.nodes.count() == 1 or rag.tokens_of(rag.linearize(some)) <= budget
    a = rag.graph_rag(harbours, "which way?", anchor=21, budget=30, llm=rag.MockProvider("south"))
    assert a.answer == "south" and (a.tokens <= 30 or a.nodes == 1)


def test_linear_algebra(spark, make_graph):
    g = make_graph([1, 2, 3], [(1, 2, 2), (2, 3, 3)])
    e = linalg.csr_entries(g.nodes, g.edges)
    assert pairs(e, "row", "col", "value") == {(0, 1, 2.0), (1, 2, 3.0)} and linalg.nnz(e) == 2
    x = spark.createDataFrame([(0, 1.0), (1, 10.0), (2, 100.0)], "i long, value double")
    assert pairs(linalg.spmv(e, x), "row", "value") == {(0, 20.0), (1, 300.0)}
    f = spark.createDataFrame([(1, [1.0, -1.0]), (2, [2.0, 0.0]), (4, [5.0, 5.0])], "node_id long, features array<double>")
    got = {r["node_id"]: r["features"] for r in linalg.message_passing(f, g.edges, "sum", "relu").collect()}
    assert got == {1: [4.0, 0.0], 2: [2.0, 0.0], 4: [5.0, 5.0]}


def test_reduced(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 9)) if i % 3 else 4, float(rng.normal()), rng.normal(size=3).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, w double, features array<double>").repartition(5)
    for how, fn in (("sum", np.sum), ("mean", np.mean), ("max", np.max)):
        got = {r["k"]: r["features"] for r in linalg.reduced(df, "k", how).collect()}
        assert set(got) == {r[0] for r in rows}
        for k, x in got.items():
            assert x == pytest.approx(fn(np.array([np.array(f) * w for i, w, f in rows if i == k]), axis=0))
    assert linalg.reduced(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        linalg.reduced(df, "k", "median")


def clustered(n, dim, clusters, spread, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_index(spark, tmp_path, metric):
    """Recall over clustered vectors from under a quarter of the cells; rows come, go and change; saved and loaded."""
    import numpy as np

    x = clustered(2000, 32, 60, 0.5, 3)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")
    index = vector.InvertedIndex.build(nodes, cells=48, metric=metric)
    assert index.probes < 12
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 2000, 100):
        d = vector._distances(metric, x[q : q + 1], x)[0]
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r["node_id"] for r in index.search(x[q].tolist(), 10).collect()})
    assert hits / 200 >= 0.95
    index = index.insert(spark.createDataFrame([(5000, x[7].tolist()), (8, x[7].tolist())], "node_id long, embedding array<double>"))
    assert {5000, 7, 8} <= {r["node_id"] for r in index.search(x[7].tolist(), 3).collect()}
    index = index.remove(spark.createDataFrame([(7,), (99_999,)], "node_id long"))
    index.save(str(tmp_path / "index"))
    back = vector.InvertedIndex.load(spark, str(tmp_path / "index"))
    assert back.probes == index.probes and back.rows.count() == 2000
    found = back.search(x[7].tolist(), 2)
    assert {r["node_id"] for r in found.collect()} == {5000, 8}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan or "PartitionFilters: [isnotnull(cell#" in plan
    assert index.rebuilt().rows.count() == 2000
    with pytest.raises(DimensionMismatch):
        index.insert(spark.createDataFrame([(1, [1.0])], "node_id long, embedding array<double>"))
    assert vector.InvertedIndex.build(nodes.limit(0)).rows.count() == 0


def test_edge_gradients(make_graph, spark):
    import numpy as np

    g = make_graph([1, 2, 3], [(1, 2, 0.7), (2, 3, 1.3), (1, 3, 0.2)], {1: [1.0, 0.2], 2: [0.4, 0.9], 3: [0.1, 0.3]})
    d = gnn.gather(g, spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "node_id long, label int"))
    on = np.arange(3)
    for how in ("sum", "mean", "max"):
        m = gnn.initial(2, 2, gnn.Config(hidden=(4, 3), activation="tanh", aggregate=how, seed=2))
        got = gnn.edge_gradients(m, d, on)
        for e in range(len(d.w)):
            was = d.w[e]
            d.w[e] = was + 1e-6
            hi = gnn.loss_and_gradients(m, d, on)[0]
            d.w[e] = was - 1e-6
            lo = gnn.loss_and_gradients(m, d, on)[0]
            d.w[e] = was
            assert got[e] == pytest.approx((hi - lo) / 2e-6, abs=1e-6)


def test_update_takes_the_smallest_patch(spark, make_graph):
    g = make_graph([1, 2], [(1, 2, 1)])
    g = mutate.update(g, spark.createDataFrame([(1, '{"a": 2}'), (1, '{"a": 1}'), (None, "{}"), (2, None)], "id long, patch string"))
    assert pairs(g.nodes, "node_id", "properties") == {(1, '{"a":1}'), (2, "{}")}
    g = mutate.update(g, spark.createDataFrame([(1, '{"b": 1}')], "id long, patch string"), "edge")
    assert pairs(g.edges, "edge_id", "properties") == {(1, '{"b":1}')}


def test_gnn(spark, make_graph):
    vectors = {1: [1.0, 0.0], 2: [0.8, 0.2], 3: [0.2, 0.8], 4: [0.0, 1.0]}
    g = make_graph([1, 2, 3, 4], [(1, 2, 2), (3, 4, 2), (2, 3, 0.1)], vectors)
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "node_id long, label int")
    d = gnn.gather(g, labels)
    for how in ("sum", "mean", "max"):
        m = gnn.initial(2, 2, gnn.Config(hidden=(3,), activation="tanh", aggregate=how))
        import numpy as np

        _, grads = gnn.loss_and_gradients(m, d, np.arange(4))
        for p, gr in zip(gnn.parameters(m), grads, strict=True):
            i = tuple(0 for _ in p.shape)
            was = p[i]
            p[i] = was + 1e-5
            hi = gnn.loss_and_gradients(m, d, np.arange(4))[0]
            p[i] = was - 1e-5
            lo = gnn.loss_and_gradients(m, d, np.arange(4))[0]
            p[i] = was
            assert gr[i] == pytest.approx((hi - lo) / 2e-5, abs=1e-6)
    m = gnn.train(d, gnn.Config(hidden=(8,), epochs=200, rate=0.02))
    assert m.history[-1] < m.history[0] and gnn.accuracy(m, d) == 1.0
    frame = gnn.predict_frame(m, g.nodes.select("node_id", F.col("embedding").alias("features")), g.edges)
    assert dict(pairs(frame, "node_id", "label")) == {1: 0, 2: 0, 3: 1, 4: 1}


def test_partitioning_and_seals(spark, harbours):
    import numpy as np

    h = 0xCBF29CE484222325
    for b in (5).to_bytes(8, "little"):
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert int(partition.fnv1a(np.array([5], np.uint64))[0]) == h
    assert [r[0] for r in spark.range(5).select(partition.range_shard(F.col("id"), [2, 4])).collect()] == [0, 0, 1, 1, 2]
    s = sealed.seal(harbours.nodes, b"key")
    found = sealed.search(s, sealed.tag(b"key", "Ship")).collect()
    assert len(found) == 1 and sealed.unseal(b"key", found[0]["payload"])["name"] == "Marlin"


def test_sources(spark, harbours, tmp_path):
    import json

    store = io.ColdStore(spark, str(tmp_path / "cold"))
    assert store.read("a") is None and store.list() == []
    store.write("a", harbours)
    back = store.read("a")
    assert store.list() == ["a"] and pairs(back.edges, *back.edges.columns) == pairs(harbours.edges, *harbours.edges.columns)
    assert store.delete("a") and not store.delete("a")
    (tmp_path / "g.json").write_text(json.dumps([{"type": "node", "id": 5, "labels": ["P"], "properties": {"x": 1}}, {"type": "node", "id": 6}, {"type": "edge", "source": 5, "target": 6}, {"type": "what"}]))
    g, odd = io.read_json(spark, str(tmp_path / "g.json"))
    assert odd == 1 and g.edges.select("edge_type", "weight").first() == ("RELATED_TO", 1.0)
    assert g.query("MATCH (a:P)-[]->(b) RETURN a.x, id(b)").collect() == [(1, 6)]
    io.write_json(g, str(tmp_path / "out"))
    flat = spark.createDataFrame([(1, "n", 0.5, 0.5)], "k long, name string, e0 double, e1 double")
    n = io.nodes_from_frame(flat, "Thing", embedding_cols=["e0", "e1"]).first()
    assert n["labels"] == ["Thing"] and n["embedding"] == [0.5, 0.5] and json.loads(n["properties"]) == {"k": 1, "name": "n"}
    start = io.empty(spark)
    start = io.ingest(start, spark.createDataFrame([('["A"]', "{}")] * 2, "labels string, properties string"))
    start = io.ingest(start, spark.createDataFrame([(1, 2, "T", "{}", 2.0)], "source long, target long, edge_type string, properties string, weight double"))
    assert start.edges.count() == 1 and start.nodes.count() == 2
    with pytest.raises(NodeNotFound):
        io.ingest(start, spark.createDataFrame([(1, 9, "T", "{}", 2.0)], "source long, target long, edge_type string, properties string, weight double"))
    assert io.to_utf8(harbours.query("MATCH (n:Ship) RETURN id(n) AS i, labels(n) AS l")).first() == ("24", '["Ship","Ferry"]')


def test_streaming(spark, tmp_path):
    from graphspark.streaming.events import read_events, validity_edges, windowed_counts

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200).write.parquet(str(tmp_path / "in"))
    events = read_events(spark, str(tmp_path / "in"))
    q = windowed_counts(events).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] > 0
    q = validity_edges(events).writeStream.outputMode("append").format("memory").queryName("spans").start()
    q.processAllAvailable()
    q.stop()
    users = spark.read.parquet(str(tmp_path / "in")).select("user_id").distinct().count()
    assert spark.table("spans").count() == 200 - users
    assert spark.table("spans").where("valid_to < valid_from").count() == 0
