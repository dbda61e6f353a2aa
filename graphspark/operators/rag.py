"""Subgraphs and their text for retrieval-augmented generation."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.errors import GraphError
from graphspark.graph import PropertyGraph
from graphspark.operators.traverse import bfs
from graphspark.operators.vector import knn
from graphspark.session import cut

FORMATS = ("prose", "structured", "triples", "json")


@dataclass(frozen=True)
class Subgraph:
    """nodes carry `pos`, their place from 0 in breadth-first order (depth, node_id)."""

    center: int
    nodes: DataFrame
    edges: DataFrame


def extract_subgraph(g: PropertyGraph, center: int, hops: int = 3, max_nodes: int = 50) -> Subgraph:
    """The first max_nodes nodes around the center, and the edges between them."""
    near = bfs(g, center, hops).orderBy("depth", "node_id").limit(max_nodes)
    near = cut(near.withColumn("pos", F.row_number().over(Window.orderBy("depth", "node_id")) - 1))  # max_nodes rows
    nodes = g.nodes.join(F.broadcast(near), "node_id")
    keep = near.select("node_id")
    edges = g.edges.join(F.broadcast(keep.withColumnRenamed("node_id", "src")), "src", "left_semi").join(F.broadcast(keep.withColumnRenamed("node_id", "dst")), "dst", "left_semi")
    return Subgraph(center, nodes, edges)


def extract_subgraph_semantic(g: PropertyGraph, query: Sequence[float], hops: int = 3, max_nodes: int = 50, metric: str = "cosine") -> Subgraph:
    top = knn(g.nodes, query, 1, metric).first()
    if top is None:
        raise GraphError("no node has an embedding")
    return extract_subgraph(g, top["node_id"], hops, max_nodes)


def display_name(props: Column, node: Column) -> Column:
    return F.coalesce(F.get_json_object(props, "$.name"), F.concat(F.lit("n"), node.cast("string")))


def display_label(labels: Column) -> Column:
    return F.coalesce(F.get(labels, 0), F.lit("Node"))


def display_props(props: Column, but: str | None = "name") -> Column:
    """`key: value` pairs by key; strings are quoted."""
    pairs = F.map_entries(F.from_json(props, "map<string,string>"))
    typed = F.transform(F.array_sort(F.filter(pairs, lambda e: (e["key"] != but) if but else F.lit(True))), lambda e: F.concat(e["key"], F.lit(": "), _shown(e["value"], props, e["key"])))
    return F.coalesce(F.array_join(typed, ", "), F.lit(""))


def _shown(value: Column, props: Column, key: Column) -> Column:
    """A JSON string keeps its quotes: the value is quoted if the text of the object has it in quotes."""
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    return F.when(F.contains(props, F.concat(F.lit('"'), key, F.lit('":'), quoted)), quoted).otherwise(value)


def _named(s: Subgraph) -> tuple[DataFrame, DataFrame]:
    nodes = s.nodes.select("node_id", "pos", display_name(F.col("properties"), F.col("node_id")).alias("name"), display_label(F.col("labels")).alias("label"), display_props(F.col("properties")).alias("props"))
    ends = nodes.select("node_id", "pos", "name", "label", "props")
    a = ends.select(*(F.col(c).alias(f"s_{c}") for c in ends.columns))
    b = ends.select(*(F.col(c).alias(f"t_{c}") for c in ends.columns))
    edges = s.edges.select("src", "dst", "edge_id", "edge_type", display_props(F.col("properties"), None).alias("e_props"))
    return nodes, edges.join(F.broadcast(a), F.col("src") == F.col("s_node_id")).join(F.broadcast(b), F.col("dst") == F.col("t_node_id"))


def _wrapped(text: str, open_: str, close: str) -> Column:
    return F.when(F.col(text) != "", F.concat(F.lit(" " + open_), F.col(text), F.lit(close))).otherwise("")


def lines(s: Subgraph, how: str = "structured") -> DataFrame:
    """(pos, kind, line): the text of a subgraph in reading order (pos, kind, line); pos is that of the node or source."""
    nodes, edges = _named(s)
    if how == "triples":
        return edges.select(F.col("s_pos").alias("pos"), F.lit(1).alias("kind"), F.concat(F.lit("("), "s_name", F.lit(", "), "edge_type", F.lit(", "), "t_name", F.lit(")")).alias("line"))
    if how == "structured":
        head = nodes.select("pos", F.lit(0).alias("kind"), F.concat(F.lit("Node ["), "label", F.lit(": "), "name", F.lit("]"), _wrapped("props", "(", ")")).alias("line"))
        kind = F.concat(F.lit("  -["), "edge_type", _wrapped("e_props", "{", "}"), F.lit("]-> ["), "t_label", F.lit(": "), "t_name", F.lit("]"), _wrapped("t_props", "(", ")"))
        return head.union(edges.select("s_pos", F.lit(1), kind))
    if how == "prose":
        head = nodes.select("pos", F.lit(0).alias("kind"), F.concat("name", F.lit(" is a "), "label", _wrapped("props", "(", ")"), F.lit(".")).alias("line"))
        return head.union(edges.select("s_pos", F.lit(1), F.concat("s_name", F.lit(" "), "edge_type", F.lit(" "), "t_name", _wrapped("e_props", "{", "}"), F.lit("."))))
    raise ValueError(f"format must be one of {FORMATS}")


def linearize(s: Subgraph, how: str = "structured") -> str:
    """The text of a subgraph; it has at most max_nodes nodes, so it is put together on the driver."""
    if how == "json":
        nodes = [{"id": r["node_id"], "labels": list(r["labels"]), "properties": json.loads(r["properties"] or "{}")} for r in s.nodes.orderBy("pos").toLocalIterator()]
        edges = [{"id": r["edge_id"], "source": r["src"], "target": r["dst"], "type": r["edge_type"], "properties": json.loads(r["properties"] or "{}")} for r in s.edges.orderBy("src", "dst", "edge_type").toLocalIterator()]
        return json.dumps({"nodes": nodes, "edges": edges})
    rows = lines(s, how).orderBy("pos", "kind", "line").collect()
    if how == "prose":  # a node's sentences share its line
        by: dict[int, list[str]] = {}
        for r in rows:
            by.setdefault(r["pos"], []).append(r["line"])
        return "\n".join(" ".join(v) for _, v in sorted(by.items()))
    return "\n".join(r["line"] for r in rows)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def tokens_of(text: str) -> int:
    return -(-len(text.encode()) // 4)


def extract_with_budget(g: PropertyGraph, center: int, hops: int, budget: int, how: str = "structured", max_nodes: int = 1_000) -> Subgraph:
    """Nodes in breadth-first order while the text keeps within the budget; the first always stays.

    A line counts from the node on that completes it: an edge when its later end comes in. Running sums over these lengths
    give the text's size after each node, so one pass decides.
    """
    s = extract_subgraph(g, center, hops, max_nodes)
    nodes, edges = _named(s)
    size = lambda c: F.octet_length(c) + 1
    full = lines(s, how)
    if how == "triples":
        heads = nodes.select("pos", F.lit(0).alias("bytes"))
    else:
        heads = full.where("kind = 0").select("pos", size("line").alias("bytes"))
    tails = edges.select(F.greatest("s_pos", "t_pos").alias("pos"), size(F.concat("s_name", "edge_type", "t_name", "e_props", F.lit("        "))).alias("bytes"))
    if how == "structured":
        tails = edges.select(F.greatest("s_pos", "t_pos").alias("pos"), size(F.concat(F.lit("  -["), "edge_type", _wrapped("e_props", "{", "}"), F.lit("]-> ["), "t_label", F.lit(": "), "t_name", F.lit("]"), _wrapped("t_props", "(", ")"))).alias("bytes"))
    per = heads.union(tails).groupBy("pos").agg(F.sum("bytes").alias("bytes"))
    running = per.withColumn("total", F.sum("bytes").over(Window.orderBy("pos")))  # max_nodes rows
    last = running.where(F.ceil((F.col("total") - 1) / 4) > budget).agg(F.min("pos").alias("p")).first()["p"]
    if last is None:
        return s
    keep = s.nodes.where(F.col("pos") < max(1, last))
    ids = keep.select("node_id")
    return Subgraph(center, keep, s.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"))


class LlmProvider(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class MockProvider:
    def __init__(self, answer: str = "mock response"):
        self.answer = answer

    def complete(self, system: str, prompt: str) -> str:
        return self.answer


def system_prompt(context: str) -> str:
    return f"Given the following graph context:\n\n{context}"


def user_prompt(question: str) -> str:
    return f"Answer the question: {question}"


@dataclass(frozen=True)
class RagAnswer:
    answer: str | None
    context: str
    nodes: int
    edges: int
    tokens: int


def graph_rag(g: PropertyGraph, question: str, query: Sequence[float] | None = None, anchor: int | None = None, hops: int = 3, max_nodes: int = 50, budget: int = 4_000, how: str = "structured", llm: LlmProvider | None = None) -> RagAnswer:
    """Anchor by nearest embedding, a subgraph around it, its text halved until it fits the budget, and an answer if there is a model."""
    if anchor is None:
        top = knn(g.nodes, query or [], 1).first()
        if top is None:
            raise GraphError("no node has an embedding")
        anchor = top["node_id"]
    while True:
        s = extract_subgraph(g, anchor, hops, max_nodes)
        text = linearize(s, how)
        if tokens_of(text) <= budget or max_nodes == 1:
            break
        max_nodes = max(1, max_nodes // 2)
    answer = llm.complete(system_prompt(text), user_prompt(question)) if llm else None
    return RagAnswer(answer, text, s.nodes.count(), s.edges.count(), tokens_of(text))


def embed(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    """df with embeddings of a text column from a provider, a batch of rows at a time."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider(s.fillna("").tolist()))

    return df.withColumn(name, run(F.col(text)))


def hash_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: counts of hashed words."""
    import re
    import zlib

    words = re.compile(r"[^\x20\x09-\x0D]+")

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in words.findall(t.lower()):
                v[zlib.crc32(w.encode()) % dimension] += 1.0
            out.append(v)
        return out

    return run
