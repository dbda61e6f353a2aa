"""Changes as new snapshots. Every operator works on whole batches; a batch is applied or, on an error, is not.

A snapshot keeps its typed tables: what goes is left out by anti-joins, what is new or changed becomes a small table of
its own, and only the properties of that are looked through for their types.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.errors import AnalysisError, DimensionMismatch, DuplicateNode, NodeNotFound
from graphspark.graph import DEFAULT_EDGE_TYPE, EDGES, NODES, PropertyGraph, union
from graphspark.session import cut


@dataclass
class QueryStats:
    nodes_created: int = 0
    edges_created: int = 0
    nodes_deleted: int = 0
    edges_deleted: int = 0
    properties_set: int = 0
    #: What CREATE ... RETURN returns.
    rows: DataFrame | None = None


def merged(old, patch):
    """Shallow JSON merge: keys of the patch win, a null value included; a patch that is no object replaces."""
    a, b = F.from_json(old, "map<string,variant>"), F.from_json(patch, "map<string,variant>")
    both = F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce(a, F.create_map().cast("map<string,variant>"))), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))
    return F.when(b.isNull(), patch).otherwise(F.to_json(both))


def _next(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def create_nodes(g: PropertyGraph, rows: Iterable[dict[str, Any]]) -> tuple[PropertyGraph, list[int]]:
    """Nodes of {labels, properties, embedding, id}; ids that are not given follow the largest."""
    rows = list(rows)
    nodes = g.nodes
    given = [r["id"] for r in rows if r.get("id") is not None]
    if len(set(given)) < len(given) or (given and not g.lookup(*given).isEmpty()):
        raise DuplicateNode(str(sorted(given)))
    sizes = {len(r["embedding"]) for r in rows if r.get("embedding") is not None}
    if sizes:
        known = nodes.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
        if len(sizes | ({known[0]} if known else set())) > 1:
            raise DimensionMismatch(str(sorted(sizes)))
    free = max([_next(nodes, "node_id"), *(i + 1 for i in given)]) if any(r.get("id") is None for r in rows) else 0
    ids, data = [], []
    for r in rows:
        i = r.get("id")
        if i is None:
            i, free = free, free + 1
        ids.append(i)
        data.append((i, list(r.get("labels", [])), json.dumps(r.get("properties", {}), sort_keys=True), r.get("embedding")))
    return g.plus(nodes=g.spark.createDataFrame(data, NODES)), ids


def create_edges(g: PropertyGraph, rows: Iterable[dict[str, Any]]) -> tuple[PropertyGraph, list[int]]:
    """Edges of {src, dst, type, properties, weight, valid_from, valid_to}; both ends must exist."""
    rows = list(rows)
    first = _next(g.edges, "edge_id")
    data = [(first + k, r["src"], r["dst"], r.get("type", DEFAULT_EDGE_TYPE), json.dumps(r.get("properties", {}), sort_keys=True), float(r.get("weight", 1.0)), r.get("valid_from"), r.get("valid_to")) for k, r in enumerate(rows)]
    return add_edges(g, g.spark.createDataFrame(data, EDGES)), [d[0] for d in data]


def add_edges(g: PropertyGraph, new: DataFrame) -> PropertyGraph:
    """A frame of edges after a check that their ends exist."""
    ends = new.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    lost = ends.join(g.nodes.select("node_id"), "node_id", "left_anti").first()
    if lost is not None:
        raise NodeNotFound(str(lost["node_id"]))
    return g.plus(edges=new)


def update(g: PropertyGraph, patches: DataFrame, what: str = "node") -> PropertyGraph:
    """patches (id, patch as JSON text) merged into the properties of nodes or edges; embeddings stay.

    Of several patches for one id the smallest text counts. Rows without a patch stay in their tables.
    """
    key = "node_id" if what == "node" else "edge_id"
    p = cut(patches.where("id is not null and patch is not null").groupBy(F.col("id").alias(key)).agg(F.min("patch").alias("patch")))
    tables = g.node_tables if what == "node" else g.edge_tables
    hit = union(replace(t, df=t.df.join(p.select(key), key, "left_semi")).canonical() for t in tables)
    new = cut(hit.join(p, key).withColumn("properties", merged(F.col("properties"), F.col("patch"))).select(*hit.columns))
    rest = tuple(replace(t, df=t.df.join(p.select(key), key, "left_anti")) for t in tables)
    return replace(g, node_tables=rest).plus(nodes=new) if what == "node" else replace(g, edge_tables=rest).plus(edges=new)


def delete_nodes(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without these nodes (node_id) and every edge at them; ids that don't exist are no error."""
    return g.without(ids)


def delete_edges(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    gone = ids.select("edge_id").distinct()
    return replace(g, edge_tables=tuple(replace(t, df=t.df.join(gone, "edge_id", "left_anti")) for t in g.edge_tables))


def delete_by_label(g: PropertyGraph, label: str) -> tuple[PropertyGraph, int]:
    gone = g.nodes.where(F.array_contains("labels", label)).select("node_id")
    return delete_nodes(g, gone), gone.count()


def write_query(g: PropertyGraph, q) -> tuple[PropertyGraph, QueryStats]:
    """CREATE and MATCH ... CREATE, both with RETURN if wanted, MATCH ... SET and MATCH ... DELETE."""
    from graphspark.plans import syntax as X
    from graphspark.plans.compiler import Compiler

    stats = QueryStats()
    matched = {x.var for p in q.paths for x in (*p.nodes, *p.edges) if x.var}
    bindings = None
    if q.paths:
        c = Compiler(g)
        c.note(q.where)
        for v in matched:
            c.needs[v].add("id")
        for target, e in q.sets:
            c.note(target)
            c.note(e)
        rows = c.bindings(q)
        edge_vars = {v for v, b in c.bound.items() if b.is_edge}
        keep = [F.col(f"{v}__id") for v in sorted(matched)]
        values = [c.value(e).col.alias(f"__v{k}") for k, (_, e) in enumerate(q.sets)]
        bindings = cut(rows.select(*keep, *values))
    if q.create:
        made: dict[str, int] = {}
        made_edges: dict[str, int] = {}
        new_nodes, links = [], []
        count = 0
        for p in q.create:
            names = []
            for n in p.nodes:
                name = n.var or f"__c{count}"
                count += 1
                if name not in made and name not in matched:
                    made[name] = len(new_nodes)
                    new_nodes.append((list(n.labels), dict(n.props)))
                names.append(name)
            for k, e in enumerate(p.edges):
                if e.var:
                    made_edges[e.var] = len(links)
                a, b = (names[k + 1], names[k]) if e.direction == "in" else (names[k], names[k + 1])
                links.append((a, b, e.types[0] if e.types else DEFAULT_EDGE_TYPE, json.dumps(dict(e.props), sort_keys=True)))
        if bindings is None:
            bindings = g.spark.range(1).select()
            numbered, times = cut(g.spark.range(0, 1, 1, 1).select(F.col("id").alias("__row"))), 1  # written: ids known to the planner turn the joins of RETURN into products
        else:
            from graphspark.operators.ranking import global_rank

            cols = bindings.columns
            numbered = cut(global_rank(bindings, [F.col(f"`{x}`") for x in cols], "__row").withColumn("__row", F.col("__row") - 1))
            times = numbered.count()
        base, first = _next(g.nodes, "node_id") if new_nodes else 0, _next(g.edges, "edge_id") if links else 0
        nodes, edges = [], []
        width = max(1, len(new_nodes))
        at = lambda name: F.lit(base) + F.col("__row") * width + made[name] if name in made else F.col(f"{name}__id")
        for k, (labels, props) in enumerate(new_nodes):
            nodes.append(numbered.select((F.lit(base) + F.col("__row") * width + k).alias("node_id"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"), F.lit(json.dumps(props, sort_keys=True)).alias("properties"), F.lit(None).cast("array<float>").alias("embedding")))
        for k, (a, b, kind, props) in enumerate(links):
            edges.append(numbered.select((F.lit(first) + F.col("__row") * len(links) + k).alias("edge_id"), at(a).cast("long").alias("src"), at(b).cast("long").alias("dst"), F.lit(kind).alias("edge_type"), F.lit(props).alias("properties"), F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to")))
        stats.nodes_created, stats.edges_created = times * len(new_nodes), times * len(links)
        g = g.plus(cut(union(nodes)) if nodes else None, cut(union(edges)) if edges else None)
        if q.items:
            ids = {v: F.lit(base) + F.col("__row") * width + n for v, n in made.items()} | {v: F.lit(first) + F.col("__row") * len(links) + n for v, n in made_edges.items()}
            stats.rows = returned(g, q, numbered.select(*(F.col(f"{v}__id") for v in sorted(matched)), *(c.alias(f"{v}__id") for v, c in ids.items())), set(made_edges) | (edge_vars if q.paths else set()), {*made, *made_edges})
    for k, (target, _) in enumerate(q.sets):
        if not isinstance(target.of, X.Var) or target.of.name not in matched:
            raise AnalysisError("SET needs a property of a matched variable")
        v = target.of.name
        patch = F.to_json(F.struct(F.col(f"__v{k}").alias(target.name)), {"ignoreNullFields": "false"})
        rows = bindings.select(F.col(f"{v}__id").alias("id"), patch.alias("patch")).dropDuplicates(["id"])
        stats.properties_set += rows.count()
        g = update(g, rows, "edge" if v in edge_vars else "node")
    for v in q.delete:
        if v not in matched:
            raise AnalysisError(f"DELETE needs a matched variable, not {v}")
        ids = cut(bindings.select(F.col(f"{v}__id").alias("id")).distinct())
        if v in edge_vars:
            stats.edges_deleted += ids.join(g.edges.select(F.col("edge_id").alias("id")), "id").count()
            g = delete_edges(g, ids.select(F.col("id").alias("edge_id")))
        else:
            stats.nodes_deleted += ids.join(g.nodes.select(F.col("node_id").alias("id")), "id", "left_semi").count()
            ends = g.edges.select("src", "dst").join(ids.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
            stats.edges_deleted += ends.where("a or b").count()
            g = delete_nodes(g, ids.select(F.col("id").alias("node_id")))
    return g, stats


def _newest(g: PropertyGraph) -> PropertyGraph:
    """Only the rows that came last; the other tables, empty, still decide the types of properties."""
    last = lambda tables: (*(replace(t, df=t.df.where(F.lit(False))) for t in tables[:-1]), *tables[-1:])
    return replace(g, node_tables=last(g.node_tables), edge_tables=last(g.edge_tables))


def returned(g: PropertyGraph, q, ids: DataFrame, edge_vars: set[str], made: set[str]) -> DataFrame:
    """The RETURN of a write: `ids` has a column <variable>__id for each variable, looked up in the new snapshot where more is asked.

    What was created (`made`) is in the newest tables, so no others are read for it.
    """
    from graphspark.plans import syntax as X
    from graphspark.plans.compiler import Compiler

    class After(Compiler):
        def bindings(self, _):
            rows = ids.select(*(F.col(c).alias(f"__at_{c}") for c in ids.columns))
            for v in (c.removesuffix("__id") for c in ids.columns):
                self.graph = _newest(g) if v in made else g
                self.needs[v].add("id")
                if v in edge_vars:
                    scan = self.edge_scan(X.EdgePattern(v, (), (), "out"), v, (), ())[0].drop("__from", "__to")
                else:
                    scan = self.node_scan(X.NodePattern(v, (), ()), v)
                rows = rows.join(scan, F.col(f"__at_{v}__id") == F.col(f"{v}__id")).drop(f"__at_{v}__id")
            return rows

    return After(g).result(replace(q, create=[], where=None, paths=[*q.paths, *q.create]))
