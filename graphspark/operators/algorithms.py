"""Whole-graph algorithms. Each takes plain frames: nodes (node_id) and edges (src, dst, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.components import connected_components
from graphspark.operators.joins import spread_join
from graphspark.session import cut


def _ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, restrict_degree: bool = False, checkpoint_every: int = 5) -> DataFrame:
    """(node_id, rank). Unweighted; parallel edges count each; rank without an edge out is dealt to all.

    Out-degrees count edges that leave the node set unless `restrict_degree`. One pass over the edges an iteration; the
    sum of changes, the rank of nodes without edges, and the next ranks come from one written frame. Where neither is
    asked for, only every `checkpoint_every`-th frame is written.
    """
    ids = cut(_ids(nodes))
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    inside = edges.select("src", "dst").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    to_set = inside.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    degree = (to_set if restrict_degree else inside).groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(to_set.groupBy("src", "dst").agg(F.count("*").alias("m")).join(degree, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("share")))
    ranks = ids.join(degree.select(F.col("src").alias("node_id"), F.lit(True).alias("linked")), "node_id", "left").select("node_id", F.lit(1.0 / n).alias("rank"), F.coalesce("linked", F.lit(False)).alias("linked"))
    ranks = cut(ranks)
    dangling = not ranks.where(~F.col("linked")).isEmpty()
    for i in range(1, max_iterations + 1):
        loose = (ranks.where(~F.col("linked")).agg(F.sum("rank")).first()[0] or 0.0) if dangling else 0.0
        came = ranks.join(links, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        new = ranks.join(came, F.col("node_id") == F.col("dst"), "left").select("node_id", ((1 - damping) / n + damping * loose / n + damping * F.coalesce("came", F.lit(0.0))).alias("rank"), "linked", F.col("rank").alias("was"))
        new = cut(new) if i % checkpoint_every == 0 or tolerance > 0 or dangling else new
        done = tolerance > 0 and (new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < tolerance
        ranks = new.select("node_id", "rank", "linked")
        if done:
            break
    return ranks.select("node_id", "rank")


def wcc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): weakly connected components, named by their smallest node."""
    ids = _ids(nodes)
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    found = connected_components(inside, "src", "dst")
    return ids.join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _shortcuts(arcs: DataFrame) -> DataFrame:
    """arcs (u, v) with an arc from 2, 4, 8, ... steps back to each node of a chain, whose nodes have one arc in each.

    What reaches what stays the same, and long chains take as many rounds as the logarithm of their length.
    """
    step = cut(arcs.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u")).where("n = 1").select("u", "v"))
    out = arcs
    for _ in range(max(0, step.count()).bit_length()):
        far = cut(step.join(step.select(F.col("u").alias("far"), F.col("v").alias("u")), "u").select(F.col("far").alias("u"), "v"))
        if far.isEmpty():
            break
        out, step = out.union(far.where("u <> v")), far
    return out


def _hung(arcs: DataFrame) -> DataFrame | None:
    """(node_id, up, root) of the nodes of arcs (u, v) with one arc in, from `up`; root: the first node above with none or several.

    Rings of such nodes have no such root, so their smallest node takes its part. None if there are no such nodes.
    """
    up = cut(arcs.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("up")).where("n = 1").select(F.col("v").alias("node_id"), "up"))
    n = up.count()
    if n == 0:
        return None
    at = up.select("node_id", F.col("up").alias("to"), F.col("up").alias("low"), F.lit(False).alias("ended"))
    for _ in range(n.bit_length() + 1):
        far = at.select(F.col("node_id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"), F.col("ended").alias("far_ended"))
        jump = at.where("not ended").join(far, "to", "left").select("node_id", F.coalesce("far", "to").alias("to"), F.least("low", "far_low").alias("low"), F.coalesce("far_ended", F.lit(True)).alias("ended"))
        at = cut(at.where("ended").union(jump))
        ring = at.where("not ended")
        if ring.isEmpty():
            break
    # whoever has not ended by now has gone round a ring, and `to` is on it
    ring = ring.select("node_id", "to").join(ring.select(F.col("node_id").alias("to"), F.col("low").alias("root")), "to").select("node_id", "root").where("node_id <> root")
    return cut(up.join(at.where("ended").select("node_id", F.col("to").alias("root")).union(ring), "node_id"))


def _fold(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """arcs (u, v) with all that hangs from a root put into it; before them what `_unfold` needs. None if nothing hangs.

    Ways into what hangs lead through its root, so strong components of the other nodes stay what they are.
    """
    hung = _hung(arcs)
    if hung is None:
        return None
    outer = arcs.join(hung.select(F.col("node_id").alias("v")), "v", "left_anti").join(hung.select(F.col("node_id").alias("u"), "root"), "u", "left")
    links = cut(outer.select("u", F.coalesce("root", "u").alias("root"), "v"))
    return hung, links, cut(links.where("root <> v").select(F.col("root").alias("u"), "v").distinct())


def _unfold(hung: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node_id, label; a node without one is its own) and those of the hung nodes that reach their root.

    One does if an arc from it, or from one that hangs below it, leads into the root's component; that goes up by doubling steps.
    """
    label = lambda node, name: labels.select(F.col("node_id").alias(node), F.col("label").alias(name))
    back = links.where("u <> root").join(label("root", "own"), "root", "left").join(label("v", "other"), "v", "left").where(F.coalesce("own", "root") == F.coalesce("other", "v"))
    have = cut(back.select(F.col("u").alias("node_id")).distinct())
    n, more = 0, have.count()
    step = hung.where("up <> root").select("node_id", F.col("up").alias("to"))
    while more > n:
        n = more
        have = cut(have.union(have.join(step, "node_id").select("to")).distinct())
        more = have.count()
        if more > n:
            step = cut(step.join(step.select(F.col("node_id").alias("to"), F.col("to").alias("far")), "to").select("node_id", F.col("far").alias("to")))
    if n == 0:
        return labels
    found = have.join(hung.select("node_id", "root"), "node_id").join(label("root", "own"), "root", "left")
    return cut(labels.union(found.select("node_id", F.coalesce("own", "root"))))


def _spread(start: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, color): the largest color that reaches each node along arcs (u, v); start: (node_id, color)."""
    now = cut(start)
    arcs = cut(_shortcuts(arcs))
    while True:
        came = now.join(arcs, F.col("node_id") == F.col("u")).groupBy("v").agg(F.max("color").alias("came"))
        new = cut(now.join(came, F.col("node_id") == F.col("v"), "left").select("node_id", F.greatest("color", "came").alias("color"), (F.col("came") > F.col("color")).alias("changed")))
        if new.where("changed").isEmpty():
            return new.select("node_id", "color")
        now = new.select("node_id", "color")


def _tarjan(ids: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its strong component), without recursion."""
    near: dict[int, list[int]] = {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    path, on, out = [], set(), []
    for root in ids:
        if root in index:
            continue
        work = [(root, iter(near.get(root, ())))]
        index[root] = low[root] = len(index)
        path.append(root)
        on.add(root)
        while work:
            node, ahead = work[-1]
            for v in ahead:
                if v not in index:
                    index[v] = low[v] = len(index)
                    path.append(v)
                    on.add(v)
                    work.append((v, iter(near.get(v, ()))))
                    break
                if v in on:
                    low[node] = min(low[node], index[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(path.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    out += [(n, min(part)) for n in part]
    return out


def scc(nodes: DataFrame, edges: DataFrame, small: int = 200_000) -> DataFrame:
    """(node_id, component): strongly connected components, named by their smallest node.

    Nodes without an arc in or out are components of their own and go; a node with only one arc in or out is folded into
    the node at its other end, with whole chains, trees and rings at once by doubling steps, so that their length counts by
    its logarithm, and so does a row of components that are left with one arc between them. What neither gets at is coloured
    forwards and backwards: the id that is largest in a hashed order is spread along the arcs, and within a colour the nodes
    that reach its owner are one component. Every round settles a node or more, and rounds go on until all are settled; then
    the folds are undone, last first. Graphs of at most `small` nodes and arcs are solved on the driver.
    """
    left = cut(_ids(nodes))
    inside = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct()
    inside = cut(inside.join(left.withColumnRenamed("node_id", "u"), "u", "left_semi").join(left.withColumnRenamed("node_id", "v"), "v", "left_semi").select("u", "v"))
    if small and inside.count() <= small and left.count() <= small:
        return nodes.sparkSession.createDataFrame(_tarjan(sorted(r[0] for r in left.collect()), [tuple(r) for r in inside.collect()]), "node_id long, component long")
    turned = lambda arcs: arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    labels, folds = left.limit(0).select("node_id", F.col("node_id").alias("label")), []
    n = inside.count()
    while n:
        before = n
        inside = cut(inside.join(inside.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(inside.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        for way in (lambda arcs: arcs, turned):
            fold = _fold(way(inside))
            if fold is not None:
                folds.append(fold[:2])
                inside = way(fold[2])
        n = inside.count()
        if n < before:
            continue
        colors = _spread(inside.select(F.col("u").alias("node_id")).distinct().select("node_id", F.struct(F.xxhash64("node_id").alias("h"), "node_id").alias("color")), inside)
        cu, cv = colors.select(F.col("node_id").alias("u"), F.col("color").alias("cu")), colors.select(F.col("node_id").alias("v"), F.col("color").alias("cv"))
        same = cut(turned(inside.join(cu, "u").join(cv, "v").where("cu = cv")))
        reach = _spread(colors.select("node_id", F.when(F.col("node_id") == F.col("color.node_id"), 1).otherwise(0).alias("color")), same).where("color = 1").select("node_id")
        found = cut(colors.join(reach, "node_id", "left_semi").select("node_id", F.col("color.node_id").alias("label")))
        labels = cut(labels.union(found))
        inside = cut(turned(same).join(found.select(F.col("node_id").alias("u")), "u", "left_anti").join(found.select(F.col("node_id").alias("v")), "v", "left_anti").select("u", "v"))
        n = inside.count()
    for hung, links in reversed(folds):
        labels = _unfold(hung, links, labels)
    every = cut(left.join(labels, "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("label")))
    names = every.groupBy("label").agg(F.min("node_id").alias("component"), F.count("*").alias("n"))
    return spread_join(every, names, ["label"], "n", every.count()).select("node_id", "component")


def degree_centrality(nodes: DataFrame, edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(node_id, centrality): degree / (n - 1), parallel edges and edges to outside counted; 0 where n <= 1."""
    from graphspark.operators.traverse import DIRECTIONS

    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    ids = _ids(nodes)
    ends = {"outgoing": [F.col("src")], "incoming": [F.col("dst")], "both": [F.col("src"), F.col("dst")]}[direction]
    degree = edges.select(F.explode(F.array(*ends)).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    total = ids.agg(F.count("*").alias("n"))
    return ids.join(degree, "node_id", "left").crossJoin(F.broadcast(total)).select("node_id", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, max_edges: int = 20_000_000) -> DataFrame:
    """(node_id, centrality): Brandes over outgoing edges, unweighted, over (n-1)(n-2); parallel edges multiply paths.

    Every task needs the whole adjacency, so it is sent as two arrays and must have at most `max_edges` edges and nodes; sources are
    dealt over the tasks. With `sources`, their sum is scaled up to all nodes.
    """
    if max(edges.count(), _ids(nodes).count()) > max_edges:
        raise ValueError(f"betweenness is limited to {max_edges} edges and nodes; give a subset of the graph")
    ids = np.sort(_ids(nodes).toArrow().column(0).to_numpy())
    n = len(ids)
    got = edges.select("src", "dst").toArrow()
    pairs = np.stack([got.column(0).to_numpy(), got.column(1).to_numpy()], axis=1)
    pairs = pairs[np.isin(pairs, ids).all(axis=1)] if len(pairs) else pairs
    s, d = np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1])
    order = np.argsort(s, kind="stable")
    offsets, targets = np.searchsorted(s[order], np.arange(n + 1)), d[order]
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((ids, offsets, targets))
    chosen = sources.select("node_id").distinct() if sources is not None else _ids(nodes)
    count = chosen.count()
    schema = pa.schema([("node_id", pa.int64()), ("c", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, targets = sent.value
        total = np.zeros(len(ids))
        for b in batches:
            for source in np.searchsorted(ids, b.column(0).to_numpy()):
                dist, sigma = np.full(len(ids), -1), np.zeros(len(ids))
                dist[source], sigma[source] = 0, 1
                levels = [np.array([source])]
                arcs = []
                while len(levels[-1]):
                    at = levels[-1]
                    sizes = offsets[at + 1] - offsets[at]
                    u = np.repeat(at, sizes)
                    v = targets[np.repeat(offsets[at], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                    new = np.unique(v[dist[v] < 0])
                    dist[new] = len(levels)
                    on = dist[v] == len(levels)
                    np.add.at(sigma, v[on], sigma[u[on]])
                    arcs.append((u[on], v[on]))
                    levels.append(new)
                delta = np.zeros(len(ids))
                for u, v in reversed(arcs):
                    np.add.at(delta, u, sigma[u] / sigma[v] * (1 + delta[v]))
                delta[source] = 0
                total += delta
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], schema=schema)

    scale = (n / count if count else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = chosen.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "node_id long, c double").groupBy("node_id").agg(F.sum("c").alias("c"))
    return _ids(nodes).join(sums, "node_id", "left").select("node_id", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def modularity(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, modularity: sum over communities of in/2m - (total/2m)^2, edges as undirected with their weights."""
    c = communities.select("node_id", "community")
    e = edges.select("src", "dst", "weight").join(c.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst")
    both = e.select(F.col("cs").alias("c"), (F.col("cs") == F.col("cd")).alias("inside"), "weight").union(e.select("cd", F.col("cs") == F.col("cd"), "weight"))
    per = both.groupBy("c").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("inner"))
    whole = per.agg(F.sum("total").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return whole.select(F.when(F.col("m2") > 0, F.col("inner") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).otherwise(0.0).alias("modularity"))


def louvain_exact(nodes: DataFrame, edges: DataFrame, passes: int = 100, max_edges: int = 5_000_000) -> DataFrame:
    """(node_id, community): one level of greedy moves, nodes in order, ties to the smaller community, labels in node order.

    The moves are sequential by definition, so this is for graphs of at most `max_edges` edges; see louvain for larger.
    """
    if edges.count() > max_edges:
        raise ValueError(f"the sequential form is limited to {max_edges} edges; use louvain")
    ids = sorted(r[0] for r in _ids(nodes).toLocalIterator())
    known = set(ids)
    near: dict[int, dict[int, float]] = {i: {} for i in ids}
    for s, d, w in edges.select("src", "dst", "weight").orderBy("src", "dst", "weight").toLocalIterator():
        if s in known and d in known:
            near[s][d] = near[s].get(d, 0.0) + w
            near[d][s] = near[d].get(s, 0.0) + w
    degree = {i: sum(near[i].values()) for i in ids}
    m = sum(degree.values()) / 2
    community, total = {i: i for i in ids}, dict(degree)
    moved = m > 0
    while moved and passes:
        moved, passes = False, passes - 1
        for i in ids:
            here = community[i]
            to: dict[int, float] = {}
            for j, w in near[i].items():
                if j != i:
                    to[community[j]] = to.get(community[j], 0.0) + w
            inside = to.get(here, 0.0)
            best, gain = here, 1e-12
            for c in sorted(to):
                if c != here:
                    g = (to[c] - inside) / m - degree[i] * (total[c] - (total[here] - degree[i])) / (2 * m * m)
                    if g > gain + 1e-12:
                        best, gain = c, g
            if best != here:
                total[here] -= degree[i]
                total[best] += degree[i]
                community[i], moved = best, True
    labels: dict[int, int] = {}
    rows = [(i, labels.setdefault(community[i], len(labels))) for i in ids]
    return nodes.sparkSession.createDataFrame(rows, "node_id long, community long")


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node_id, community): synchronous moves. Each round a hashed half of the nodes moves to its best neighbouring community.

    Gains come from sums over (node, community) and (community), so every step is a grouped aggregate; half at a time
    keeps neighbours from swapping places. Stops after two rounds in which nobody moves, or after `rounds`. One level, and
    the same at every size; `louvain_exact` is the sequential form.
    """
    ids = cut(_ids(nodes))
    both = edges.select("src", "dst", "weight").where("src <> dst")
    both = cut(both.union(both.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"))
    degree = cut(both.groupBy("src").agg(F.sum("w").alias("k")))
    m = (degree.agg(F.sum("k")).first()[0] or 0.0) / 2
    now = cut(ids.withColumn("community", F.col("node_id")))
    still = 0
    for r in range(rounds if m else 0):
        here = now.select(F.col("node_id").alias("src"), F.col("community").alias("own"))
        there = now.select(F.col("node_id").alias("dst"), F.col("community").alias("c"))
        to = both.join(there, "dst").groupBy("src", "c").agg(F.sum("w").alias("k_c"))
        total = now.join(degree, F.col("node_id") == F.col("src")).groupBy("community").agg(F.sum("k").alias("t"))
        rows = to.join(here, "src").join(degree, "src").join(total.select(F.col("community").alias("c"), F.col("t").alias("t_c")), "c")
        inside = rows.where("c = own").select("src", F.col("k_c").alias("k_in"))
        rows = rows.where("c <> own").join(inside, "src", "left").join(total.select(F.col("community").alias("own"), F.col("t").alias("t_own")), "own")
        gain = (F.col("k_c") - F.coalesce("k_in", F.lit(0.0))) / m - F.col("k") * (F.col("t_c") - (F.col("t_own") - F.col("k"))) / (2 * m * m)
        move = rows.withColumn("gain", gain).where((F.col("gain") > 1e-12) & (F.pmod(F.xxhash64("src", F.lit(r)), F.lit(2)) == 0))
        best = move.groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("c"))).alias("b")).select("src", F.col("b.c").alias("to"))
        new = cut(now.join(best, F.col("node_id") == F.col("src"), "left").select("node_id", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")))
        still = 0 if not new.where("moved").isEmpty() else still + 1
        now = new.select("node_id", "community")
        if still == 2:
            break
    names = now.groupBy("community").agg(F.min("node_id").alias("name"))
    return now.join(names, "community").select("node_id", F.col("name").alias("community"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, total): nodes, edges, nodes for each label, edges for each type."""
    label = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("total")).select(F.lit("label").alias("kind"), "name", "total")
    kind = edges.groupBy(F.col("edge_type").alias("name")).agg(F.count("*").alias("total")).select(F.lit("edge_type").alias("kind"), "name", "total")
    all_nodes = nodes.agg(F.count("*").alias("total")).select(F.lit("nodes").alias("kind"), F.lit("").alias("name"), "total")
    all_edges = edges.agg(F.count("*").alias("total")).select(F.lit("edges").alias("kind"), F.lit("").alias("name"), "total")
    return all_nodes.union(all_edges).union(label).union(kind)
