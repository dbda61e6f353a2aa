"""Neighbours, breadth- and depth-first search, and shortest paths. All follow `direction`, outgoing by default."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.graph import FEW_IDS, Key, PropertyGraph, union
from graphspark.session import cut

DIRECTIONS = ("outgoing", "incoming", "both")
#: Graphs of at most so many arcs are solved on the driver where an operator says so.
SMALL = 200_000
#: Frontiers of at most so many rows are broadcast, so that the arcs stay where they are.
FRONTIER = 100_000
#: Steps back from the end of a path that one job fetches.
STEPS_BACK = 8
#: Milliseconds of the smallest spans that an as-of join tells apart.
MOMENT = 60_000


def _sent(frontier: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frontier) if rows <= FRONTIER else frontier


def arcs(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Edges as (edge_id, u, v, edge_type, weight) in the walking direction; a self-loop is walked once."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    rest = ["edge_id", "edge_type", "weight"]
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *rest)
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), *rest)
    if direction == "outgoing":
        return out
    return back if direction == "incoming" else out.union(back.where(F.col("u") != F.col("v")))


def arcs_at(g: PropertyGraph, ids: Iterable[int], direction: str = "outgoing", *types: str) -> DataFrame:
    """The arcs that leave a few nodes, from the tables that can have them, by filters on their own keys."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    ids = list(ids)
    out = arcs(g.touching("src", ids, *types))
    if direction == "outgoing":
        return out
    back = arcs(g.touching("dst", ids, *types), "incoming")
    return back if direction == "incoming" else out.union(back.where(F.col("u") != F.col("v")))


def neighbors(g: PropertyGraph, node: int, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """(edge_id, node_id, edge_type, weight), one row for each edge."""
    return arcs_at(g, [node], direction, *([edge_type] if edge_type else [])).select("edge_id", F.col("v").alias("node_id"), "edge_type", "weight")


def temporal_diff(g: PropertyGraph, node: int, t1: int, t2: int, direction: str = "outgoing") -> DataFrame:
    """Neighbours at two moments: (node_id, edge_type, status) with status added, removed or kept."""
    key = ["node_id", "edge_type"]
    a = neighbors(g.at(t1), node, direction).select(*key).distinct().withColumn("before", F.lit(True))
    b = neighbors(g.at(t2), node, direction).select(*key).distinct().withColumn("after", F.lit(True))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(*key, status.alias("status"))


def _ways(g: PropertyGraph, direction: str) -> list[tuple[DataFrame, str, str, Key | None]]:
    """(table, column walked from, column walked to, key of the former) for every table and walking direction."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    out = [(t.df, "src", "dst", t.src_key) for t in g.edge_tables] if direction != "incoming" else []
    return out + ([(t.df, "dst", "src", t.dst_key) for t in g.edge_tables] if direction != "outgoing" else [])


def bfs(g: PropertyGraph, start: int | DataFrame, max_depth: int = 3, direction: str = "outgoing") -> DataFrame:
    """(node_id, depth) with the least depth, the start at 0 (whether or not it exists).

    The frontier is a relation: each level joins it with the tables that have edges at nodes of its kinds, drops what was
    visited, and is written once, so that neither plans nor lineage grow with depth. A frontier of a few nodes is a filter
    on the keys of these tables.
    """
    spark = g.spark
    ways = _ways(g, direction)
    keys = list(dict.fromkeys(k for *_, k in ways if k is not None))
    first = start.select(F.col("node_id")) if isinstance(start, DataFrame) else spark.range(start, start + 1).select(F.col("id").alias("node_id"))
    seen = frontier = first.distinct().withColumn("depth", F.lit(0))
    spans = list(dict.fromkeys((k.base, k.size) for k in keys))

    def look(frontier: DataFrame) -> tuple[int, dict[tuple[int, int], int], list[int]]:
        """Nodes of the frontier, of each kind that has a key, and the nodes themselves if they are few."""
        row = frontier.agg(F.count("*"), *(F.count_if((F.col("node_id") >= b) & (F.col("node_id") < b + n)) for b, n in spans)).first()
        few = [r[0] for r in frontier.select("node_id").collect()] if row[0] <= FEW_IDS else []
        return row[0], dict(zip(spans, row[1:], strict=False)), few

    size, kinds, few = (1, {s: int(s[0] <= start < s[0] + s[1]) for s in spans}, [start]) if not isinstance(start, DataFrame) else look(frontier)
    total = size
    for depth in range(1, max_depth + 1):
        reached = []
        for df, a, b, key in ways:
            if key is not None and not kinds[key.base, key.size]:
                continue
            if few:
                near = df.where(key.among(few) if key is not None else F.col(a).isin(*few))
            else:
                near = df.join(_sent(frontier, size), F.col("node_id") == F.col(a), "left_semi")
            reached.append(near.select(F.col(b).alias("node_id")))
        if not reached:
            break
        frontier = cut(union(reached).distinct().join(_sent(seen.select("node_id"), total), "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        size, kinds, few = look(frontier)
        total += size
        if not size:
            break
        seen = seen.union(frontier)
    return seen


def dfs(g: PropertyGraph, start: int, max_depth: int = 3, reverse: bool = True) -> list[int]:
    """Nodes in the order of a depth-limited preorder walk; a node keeps the depth of its first visit.

    The order is sequential by nature, so the arcs among nodes within max_depth, and only they, come to the driver.
    Neighbours are taken in the order of (node_id, edge_id); `reverse=False` takes them from the end, as a plain stack does.
    """
    reach = bfs(g, start, max(0, max_depth - 1)).select("node_id")
    near: dict[int, list[int]] = {}
    rows = arcs(g.edges).join(reach, F.col("u") == F.col("node_id"), "left_semi").select("u", "v", "edge_id").orderBy("u", "v", "edge_id").toLocalIterator()
    for r in rows:
        near.setdefault(r["u"], []).append(r["v"])
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append(node)
        if depth < max_depth:
            ahead = near.get(node, [])
            stack += [(v, depth + 1) for v in (reversed(ahead) if reverse else ahead) if v not in seen]
    return out


def _small_arcs(hops: DataFrame, small: int) -> list | None:
    """The arcs (u, v, edge_id, w) if they are `small` at most, else None."""
    return hops.collect() if small and hops.count() <= small else None


def _dijkstra(arcs_: list, source: int, target: int | None) -> list[tuple]:
    near: dict[int, list] = {}
    for u, v, e, w in arcs_:
        near.setdefault(u, []).append((v, e, w))
    best, done, heap = {source: (0.0, None, None)}, set(), [(0.0, source)]
    while heap:
        cost, u = heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, e, w in near.get(u, ()):
            new, old = (cost + w, u, e), best.get(v)
            if old is None or new[0] < old[0] or (new[0] == old[0] and old[1] is not None and new[1:] < old[1:]):
                best[v] = new
                heappush(heap, (new[0], v))
    return [(n, *b) for n, b in best.items()]


def sssp(g: PropertyGraph, source: int, weighted: bool = True, max_hops: int | None = None, target: int | None = None, direction: str = "outgoing", all_nodes: bool = False, small: int = SMALL) -> DataFrame:
    """(node_id, cost, prev, prev_edge): least cost of every reachable node, by rounds of relaxation from those that changed.

    Rounds go on until nothing changes; with `max_hops`, costs are those of paths of so many edges at most. Weights are not
    negative, else it is an error. Ties go to the smaller (prev, prev_edge). With `target`, nodes that already cost more than it are not followed. With
    `all_nodes`, others come with an infinite cost. Graphs of at most `small` arcs are solved on the driver.
    """
    spark = g.spark
    hops = cut(arcs(g.edges, direction).select("u", "v", "edge_id", (F.col("weight") if weighted else F.lit(1.0)).alias("w")))
    if weighted and not hops.where("w < 0").isEmpty():
        raise ValueError("shortest paths need weights that are not negative")
    near = _small_arcs(hops, small) if max_hops is None else None
    if near is not None:
        best = spark.createDataFrame(_dijkstra([tuple(r) for r in near], source, target), "node_id long, cost double, prev long, prev_edge long")
    else:
        none = F.lit(None).cast("long")
        best = spark.range(source, source + 1).select(F.col("id").alias("node_id"), F.lit(0.0).alias("cost"), none.alias("prev"), none.alias("prev_edge"), F.lit(True).alias("fresh"))
        fresh, rounds = 1, 0
        while fresh and rounds != max_hops:
            rounds += 1
            reached = hops.join(_sent(best.where("fresh"), fresh), F.col("node_id") == F.col("u")).select(F.col("v").alias("node_id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("prev"), F.col("edge_id").alias("prev_edge")).alias("way"))
            reached = reached.groupBy("node_id").agg(F.min("way").alias("way"))
            if target is not None:
                limit = best.where(F.col("node_id") == target).agg(F.min("cost")).first()[0]
                if limit is not None:
                    reached = reached.where(F.col("way.cost") < limit)
            better = F.col("way").isNotNull() & (F.col("cost").isNull() | (F.col("way.cost") < F.col("cost")))
            pick = lambda c: F.when(better, F.col(f"way.{c}")).otherwise(F.col(c)).alias(c)
            best = cut(best.drop("fresh").join(reached, "node_id", "full").select("node_id", pick("cost"), pick("prev"), pick("prev_edge"), better.alias("fresh")))
            fresh = best.where("fresh").count()
        best = best.drop("fresh")
    if all_nodes:
        return g.nodes.select("node_id").join(best, "node_id", "left").withColumn("cost", F.coalesce("cost", F.lit(float("inf"))))
    return best


@dataclass(frozen=True)
class GraphPath:
    """start and steps of (edge_id, node_id)."""

    start: int
    steps: tuple[tuple[int, int], ...]
    cost: float

    def __len__(self) -> int:
        return len(self.steps)

    def nodes(self) -> list[int]:
        return [self.start, *(n for _, n in self.steps)]


def shortest_path(g: PropertyGraph, start: int, end: int, weighted: bool = False, direction: str = "outgoing") -> GraphPath | None:
    """The path with the fewest hops or the least weight; None if there is none. start == end has length 0."""
    if start == end:
        return GraphPath(start, (), 0.0)
    tree = cut(sssp(g, start, weighted, target=end, direction=direction))
    last = tree.where(F.col("node_id") == end).first()
    if last is None:
        return None
    back, node = {}, end
    while node != start:  # STEPS_BACK rows of the tree at a time: those that can lie on the way have costs below the node's
        if node not in back:
            rows = tree.where(F.col("node_id") == node).select("node_id", "prev", "prev_edge")
            for _ in range(STEPS_BACK):
                above = tree.join(F.broadcast(rows.select(F.col("prev").alias("node_id"))), "node_id", "left_semi").select("node_id", "prev", "prev_edge")
                rows = rows.union(above).distinct()
            back |= {r["node_id"]: (r["prev"], r["prev_edge"]) for r in rows.collect()}
        node = back[node][0]
    steps, node = [], end
    while node != start:
        steps.append((back[node][1], node))
        node = back[node][0]
    return GraphPath(start, tuple(reversed(steps)), float(last["cost"]))


def bfs_levels(g: PropertyGraph, start: int, max_depth: int = 1_000) -> DataFrame:
    """(node_id, level) of every node, -1 where the start does not reach."""
    return g.nodes.select("node_id").join(bfs(g, start, max_depth), "node_id", "left").select("node_id", F.coalesce("depth", F.lit(-1)).alias("level"))


def path_struct(path: GraphPath | None) -> list[tuple[int, int, int | None]]:
    """(position, node_id, edge_id) rows of a path."""
    return [] if path is None else [(0, path.start, None), *((i + 1, n, e) for i, (e, n) in enumerate(path.steps))]


def asof_edges(events: DataFrame, edges: DataFrame, on: str, at: str) -> DataFrame:
    """Each event with the edges of the same `on` that are valid at its moment: valid_from <= at < valid_to, a null end is open.

    Closed spans are dealt by (on, size class, place): a span falls in the class of the least power of two of MOMENT that
    covers it and so in two places at most, and an event looks in one place of each class there is. No key grows with time.
    Edges with an open end are joined on `on`. Empty spans, and a null `on` or `at`, match nothing.
    """
    lasts = F.greatest(F.col("valid_to") - F.col("valid_from"), F.lit(1))
    size = F.greatest(F.ceil(F.log2(lasts / F.lit(MOMENT))), F.lit(0)).cast("int")
    closed = edges.where("valid_from < valid_to").withColumn("__size", size)
    width = (MOMENT * F.pow(F.lit(2.0), F.col("__size"))).cast("long")
    placed = closed.withColumn("__place", F.explode(F.sequence(F.floor(F.col("valid_from") / width), F.floor((F.col("valid_to") - 1) / width))))
    used = closed.agg(F.sort_array(F.collect_set("__size"))).first()[0]  # at most 64 classes
    asked = events.withColumn("__size", F.explode(F.array(*map(F.lit, used or [-1]))))
    asked = asked.withColumn("__place", F.floor(F.col(at) / width))
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    inner = asked.join(placed, [on, "__size", "__place"]).where(valid).drop("__size", "__place")
    open_ = events.join(edges.where("valid_from is null or valid_to is null"), on).where(F.col(at).isNotNull() & valid)
    return inner.unionByName(open_)


def sample_neighbors(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """GraphSAGE sampling: (hop, u, v), for each hop up to `fanout` neighbours of each frontier node without replacement.

    Both directions count; parallel edges once. The order is a hash of the pair, so it is the same in every run.
    """
    hops = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct()
    frontier, out = seeds.select(F.col("node_id").alias("u")).distinct(), None
    for k, fanout in enumerate(fanouts):
        order = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(seed + k), "u", "v"), "v")
        got = cut(frontier.join(hops, "u").withColumn("r", F.row_number().over(order)).where(F.col("r") <= fanout).select(F.lit(k).alias("hop"), "u", "v"))
        out = got if out is None else out.union(got)
        frontier = got.select(F.col("v").alias("u")).distinct()
    return out
