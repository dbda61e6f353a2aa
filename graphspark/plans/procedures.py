"""CALL procedures of the query language."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphspark.errors import AnalysisError
from graphspark.graph import PropertyGraph
from graphspark.operators import algorithms, rag, traverse, vector
from graphspark.plans import syntax as X


def _plain(e):
    if isinstance(e, X.Literal):
        return e.value
    if isinstance(e, X.ListOf):
        return [_plain(i) for i in e.items]
    if isinstance(e, X.Unary) and e.op == "-":
        return -_plain(e.arg)
    raise AnalysisError("arguments of CALL are literals")


def _path(g: PropertyGraph, a: int, b: int, weighted: bool = False) -> DataFrame:
    rows = traverse.path_struct(traverse.shortest_path(g, a, b, weighted))
    return g.spark.createDataFrame(rows, "position int, node_id long, edge_id long")


def _rag(g: PropertyGraph, question: str, anchor: int, hops: int = 3, max_nodes: int = 50) -> DataFrame:
    a = rag.graph_rag(g, question, anchor=anchor, hops=hops, max_nodes=max_nodes)
    return g.spark.createDataFrame([(a.context, a.nodes, a.edges, a.tokens)], "context string, nodes int, edges int, tokens int")


PROCEDURES = {
    "db.index.vector.search": lambda g, q, k=10, metric="cosine": vector.knn(g.nodes, q, k, metric),
    "hybrid.search": lambda g, anchor, q, hops=3, k=10, alpha=0.5: vector.hybrid_search(g, anchor, q, hops, k, alpha),
    "algo.bfs": lambda g, start, depth=3: traverse.bfs(g, start, depth),
    "algo.shortest_path": _path,
    "algo.pagerank": lambda g, damping=0.85, iterations=100, tolerance=1e-6: algorithms.pagerank(g.nodes, g.edges, damping, iterations, tolerance),
    "algo.wcc": lambda g: algorithms.wcc(g.nodes, g.edges),
    "algo.scc": lambda g: algorithms.scc(g.nodes, g.edges),
    "algo.louvain": lambda g: algorithms.louvain(g.nodes, g.edges),
    "algo.degree": lambda g, direction="outgoing": algorithms.degree_centrality(g.nodes, g.edges, direction),
    "algo.betweenness": lambda g: algorithms.betweenness(g.nodes, g.edges),
    "temporal.neighbors_at": lambda g, node, ts, direction="outgoing": traverse.neighbors(g.at(ts), node, direction),
    "temporal.bfs_at": lambda g, start, ts, depth=3: traverse.bfs(g.at(ts), start, depth),
    "rag.query": _rag,
}


def call(g: PropertyGraph, name: str, args: tuple) -> DataFrame:
    if name not in PROCEDURES:
        raise AnalysisError(f"unknown procedure {name}")
    return PROCEDURES[name](g, *map(_plain, args))
