"""Embedding near-duplicates by NN-descent (operator 4).

Equal vectors are one class first. A neighbour graph starts from leaves of random hyperplanes, whose rows are compared in
bounded blocks, and is refined by NN-descent: every node brings together its neighbours and those it is a neighbour of,
all pairs among them are compared, and each takes over what beats the end of its list, until few lists change. An audit
answers a bounded sample by brute force, a new one each time; while the share of a vector's links that is found is too
low on average for vectors of about any number of links, more leaves are joined in and the graph is refined again. If the
last audit fails, all vectors are compared with all, in blocks. Links that an audit finds missing always join groups. Edges at `threshold` or more, less a margin for single precision, give the groups: whatever a leaf or a
meeting finds counts, as a spanning forest of it, also where k nearer neighbours keep it from the lists.

A list that holds only such edges is saturated and may leave links out, which can only lead to other saturated vectors.
So groups large enough to hold any are held against each other: a member that the triangle inequality lets reach another
group (by its centre and radius) is compared with all of that group, and a link found joins the two. Then every group is
its members' enlarged list: all of its members are compared in double precision, in blocks of BLOCK rows and pairs of
blocks, which yields each member's number of links and a spanning forest of the true links, not the pairs. Components
come from those forests.

n_links counts other vectors, so members of classes count by their size; a cosine of just the threshold links. Vectors of
different dimensions don't link: each dimension is searched on its own. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing, nor do they with each other: n_links 0, component_id their own vec_id. Rows that repeat a vec_id with an equal vector count as one other vector and each get the
same row; null vec_ids get n_links 0 and null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.llm.simhash import Forest
from graphspark.llm.vectors import dimensions, matrix, salt, unit, usable
from graphspark.operators.components import connected_components
from graphspark.operators.joins import spread_join
from graphspark.session import cut, shuffle_width

THRESHOLD = 0.95
#: Below the threshold by this much an edge still joins groups; the exact comparison decides.
MARGIN = 1e-4
K = 8
#: Rows of a leaf that are aimed at, and of a block that is compared at once.
LEAF, LEAF_BLOCK = 96, 256
#: A leaf of more rows is split before it is dealt.
LEAF_ROWS = 2 * LEAF_BLOCK
TREES = 8
ROUNDS = 6
#: NN-descent ends when no more than this share of the list places that could matter to the threshold change.
FEW, MATTERS = 0.002, 0.15
BLOCK = 256
#: Centres of groups that one pass over the members of groups is held against.
CENTRES = 4_096
#: What single precision may take from an angle, in radians.
SLACK = 2e-3
#: The same where all vectors are compared with all.
WHOLE = 2_048
AUDIT, RECALL, AUDITS = 1_024, 0.995, 3

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])
_EDGES = "u long, v long, sim float"


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim.astype(np.float32))], schema=EDGES)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, whole even across batches."""
    held: list[pa.RecordBatch] = []
    mark: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns[:keys]]
        new = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        edges = np.r_[0, np.flatnonzero(new) + 1, b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if key != mark and held:
                yield pa.Table.from_batches(held)
                held = []
            mark = key
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _floats(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1)


def leaves(units: DataFrame, count: int, trees: int, seed: int, k: int, near: float) -> DataFrame:
    """Edges (u, v, sim) to the k nearest within a block of a leaf, for `trees` sets of random hyperplanes, and a forest of those at `near`."""
    spark = units.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int64()), ("id", pa.int64()), ("x", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)
            for t in range(trees):
                planes = np.random.default_rng([seed, t]).normal(size=(x.shape[1], bits)).astype(np.float32)
                leaf = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(leaf), *b.columns], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            ids, x = group.column(3).to_numpy(), _floats(group.column(4), group.num_rows)
            for a in range(0, len(ids), LEAF_BLOCK):
                i, x_ = ids[a : a + LEAF_BLOCK], x[a : a + LEAF_BLOCK]
                if len(i) > 1:
                    yield _edges(*_best(i, x_, k, near))

    placed = units.mapInArrow(place, "tree int, leaf long, id long, x binary")
    crowded = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_ROWS).select("tree", "leaf", F.ceil(F.col("n") / LEAF_ROWS).cast("int").alias("ways"))
    dealt = placed.join(crowded, ["tree", "leaf"], "left").select("tree", "leaf", salt(F.coalesce("ways", F.lit(1)), "id").alias("salt"), "id", "x")
    return dealt.repartition(shuffle_width(spark), "tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt", "id").mapInArrow(compare, _EDGES)


def _best(ids: np.ndarray, x: np.ndarray, k: int, near: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k most similar others, above its own `floor` if given; and what joins all rows linked at `near`."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    n = min(k, len(ids) - 1)
    j = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    i = np.repeat(np.arange(len(ids)), n)
    j = j.ravel()
    s = sim[i, j]
    a, b = np.nonzero(sim >= near)
    forest = Forest(len(ids))
    if floor is not None:
        ok = s > floor[i]
        i, j, s = i[ok], j[ok], s[ok]
    ok = s >= near
    forest.link(i[ok], j[ok])
    apart = forest.label[a] != forest.label[b]
    if apart.any():  # links that no row has among its k
        a, b = a[apart], b[apart]
        _, first = np.unique(np.minimum(forest.label[a], forest.label[b]) * len(ids) + np.maximum(forest.label[a], forest.label[b]), return_index=True)
        i, j, s = np.r_[i, a[first]], np.r_[j, b[first]], np.r_[s, sim[a[first], b[first]]]
    return ids[i], ids[j], s


def _best_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each node. A node has k from each block it was in, so its rows are bounded."""
    once = _best_of(edges)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).select("u", "v", "sim", "r")


def strong(edges: DataFrame, near: float) -> DataFrame:
    """(u, v) of the edges that join groups."""
    return edges.where(F.col("sim") >= near).select("u", "v")


def refine(graph: DataFrame, units: DataFrame, k: int, near: float) -> DataFrame:
    """What one local join finds: edges better than the end of the list of their node, and a forest of those at `near`."""
    spark = units.sparkSession
    ends = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select(F.col("u").alias("id"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    # a node is in its own meeting, in those of its neighbours and of those it is a neighbour of (of the latter k by hash:
    # the rest meet at other nodes)
    back = graph.withColumn("b", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))).where(F.col("b") <= k)
    meets = graph.select(F.col("u").alias("at"), F.col("v").alias("id")).union(back.select(F.col("v"), F.col("u"))).union(graph.select("u", "u")).distinct()
    brought = meets.join(units.join(ends, "id", "left").select("id", "x", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor")), "id").select("at", "id", "x", "floor")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 1):
            if group.num_rows > 1:
                out.append(_best(group.column(1).to_numpy(), _floats(group.column(2), group.num_rows), k, near, group.column(3).to_numpy()))
            if len(out) >= 512:
                yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
                out = []
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return brought.repartition(shuffle_width(spark), "at").sortWithinPartitions("at").mapInArrow(meet, _EDGES)


def descend(graph: DataFrame, units: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """NN-descent until few list places change among edges near the threshold, lists that are saturated left aside.

    With the lists come (u, v) of all edges seen on the way that join groups, whatever their rank.
    """
    near = threshold - MARGIN
    joins = strong(graph, near)
    graph = cut(_lists(graph, k))
    for _ in range(ROUNDS):
        better = cut(_best_of(refine(graph, units, k, near)))
        joins = joins.union(strong(better, near))
        known = better.join(graph.select("u", "v"), ["u", "v"], "left_anti")
        new = cut(_lists(graph.select("u", "v", "sim").union(known), k))
        low = F.min("sim").over(Window.partitionBy("u"))
        close = new.withColumn("low", low).where((F.col("sim") >= threshold - MATTERS) & (F.col("low") < threshold)).join(graph.select("u", "v", F.lit(1).alias("old")), ["u", "v"], "left").agg(F.count("*").alias("all"), F.count("old").alias("old")).first()
        graph = new
        if close["all"] - close["old"] <= FEW * close["all"]:
            break
    return graph, joins


def _components(joins: DataFrame) -> DataFrame:
    return connected_components(joins, "u", "v").select(F.col("node").alias("id"), F.col("component").alias("grp"))


def grouped(joins: DataFrame, units: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id, grp) of nodes with an edge near the threshold or above; groups that saturated nodes keep apart are joined."""
    groups = cut(_components(joins))
    across = bridges(groups, units, threshold, k)
    if across is None:
        return groups
    return cut(_components(across.select("u", "v").union(groups.select(F.col("id").alias("u"), F.col("grp").alias("v")))))


def bridges(groups: DataFrame, units: DataFrame, threshold: float, k: int) -> DataFrame | None:
    """Links (u, v) between groups of more than k members, smaller ones hold no saturated list; None without such groups.

    Each member has one link to each block of another group that has any. Members that can't reach a group aren't compared.
    """
    spark = units.sparkSession
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > k)
    members = cut(groups.join(sizes, "grp").join(units, "id").select("grp", "size", "id", "x"))
    sums, spans = pa.schema([("grp", pa.int64()), ("s", pa.list_(pa.float64()))]), pa.schema([("grp", pa.int64()), ("radius", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                grp, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
                x = _floats(b.column(1), b.num_rows)
                s = np.zeros((len(grp), x.shape[1]))
                np.add.at(s, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(s.tolist(), type=sums.field(1).type)], schema=sums)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_angle((_floats(b.column(1), b.num_rows) * _centre(matrix(b.column(2)))).sum(axis=1)))], schema=spans)

    added = members.select("grp", "x").mapInArrow(add, "grp long, s array<double>").select("grp", F.posexplode("s")).groupBy("grp", "pos").agg(F.sum("col").alias("s"))
    sum_of = added.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("c"))
    radii = members.join(sum_of, "grp").select("grp", "x", "c").mapInArrow(span, "grp long, radius double").groupBy("grp").agg(F.max("radius").alias("radius"))
    centres = cut(sum_of.join(radii, "grp").join(sizes, "grp").select("grp", "size", "c", "radius"))
    passes = -(-centres.count() // CENTRES)
    reach = float(np.arccos(threshold)) + SLACK
    met = pa.schema([("grp", pa.int64()), ("ways", pa.int32()), ("id", pa.int64()), ("x", pa.binary())])
    found = None
    for p in range(passes):
        some = centres.where(salt(F.lit(passes), "grp") == p).collect()
        if not some:
            continue
        grp, size, radius = (np.array([r[n] for r in some]) for n in ("grp", "size", "radius"))
        sent = spark.sparkContext.broadcast((grp, size, radius, _centre(np.array([r["c"] for r in some]))))

        def visit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            grp, size, radius, c = sent.value
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    part = b.slice(a, 1024)
                    own, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                    after = (size[None, :] > n[:, None]) | ((size[None, :] == n[:, None]) & (grp[None, :] > own[:, None]))  # the smaller group visits
                    i, j = np.nonzero(after & (_angle(_floats(part.column(3), part.num_rows) @ c.T) <= radius[None, :] + reach))
                    yield pa.RecordBatch.from_arrays([pa.array(grp[j]), pa.array((-(-size[j] // BLOCK)).astype(np.int32)), part.column(2).take(pa.array(i)), part.column(3).take(pa.array(i))], schema=met)

        visits = members.mapInArrow(visit, "grp long, ways int, id long, x binary").select("grp", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("block"), F.lit(1).alias("guest"), "id", "x")
        hosts = members.join(visits.select("grp").distinct(), "grp", "left_semi").select("grp", salt(F.ceil(F.col("size") / BLOCK).cast("int"), "id").alias("block"), F.lit(0).alias("guest"), "id", "x")
        links = hosts.union(visits).repartition(shuffle_width(spark), "grp", "block").sortWithinPartitions("grp", "block", "guest").mapInArrow(_meeting(threshold - MARGIN), _EDGES)
        found = cut(links if found is None else found.union(links))
    return found


def _meeting(near: float):
    """Compares the guests of a block with its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            guest, ids = (group.column(c).to_numpy() for c in (2, 3))
            x = _floats(group.column(4), group.num_rows)
            first = int((guest == 0).sum())
            for a in range(first, len(ids), BLOCK):
                if not first:
                    break
                sim = x[a : a + BLOCK] @ x[:first].T
                best = sim.argmax(axis=1)
                top = sim[np.arange(len(best)), best]
                ok = top >= near
                yield _edges(ids[a : a + BLOCK][ok], ids[best[ok]], top[ok])

    return run


def _centre(sums: np.ndarray) -> np.ndarray:
    """Sums of unit vectors at length one. Any centre serves; that of vectors that cancel out is the zero vector, at a right angle to all."""
    size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-9)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def missed(sample: list, units: DataFrame, groups: DataFrame, threshold: float) -> tuple[DataFrame, float]:
    """Links of the bounded sample whose ends aren't in one group, and the share of a vector's links whose ends are.

    The share is the mean over the vectors that have 1, 2-3, 4-7, ... links, and the least of these: large groups count apart.
    """
    ids, x = np.array([r["id"] for r in sample], np.int64), np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float32).reshape(len(sample), -1)
    sent = units.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        for b in batches:
            if b.num_rows:
                mine = b.column(0).to_numpy()
                sim = x @ np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1).T
                i, j = np.nonzero((sim >= threshold) & (ids[:, None] != mine[None, :]))
                yield _edges(ids[i], mine[j], sim[i, j])

    a, b = groups.select(F.col("id").alias("u"), F.col("grp").alias("gu")), groups.select(F.col("id").alias("v"), F.col("grp").alias("gv"))
    true = cut(units.mapInArrow(run, _EDGES).join(a, "u", "left").join(b, "v", "left").select("u", "v", "sim", F.coalesce(F.col("gu") == F.col("gv"), F.lit(False)).alias("hit")))
    each = true.groupBy("u").agg(F.count("*").alias("all"), F.count_if("hit").alias("hit"))
    bands = each.groupBy(F.length(F.bin("all"))).agg(F.avg(F.col("hit") / F.col("all")).alias("share")).agg(F.min("share")).first()
    return true.where(~F.col("hit")).select("u", "v", "sim"), 1.0 if bands[0] is None else bands[0]


def exact_links(members: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """members (grp, id, n, v): links of each id to other classes' vectors, and a forest (a, b) of the linked classes."""
    spark = members.sparkSession
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("ways"))
    dealt = members.join(sizes, "grp").withColumn("own", salt(F.col("ways"), "id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "v")
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            own, ids, n = (g.column(c).to_numpy() for c in (3, 4, 5))
            x = unit(matrix(g.column(6).combine_chunks()).astype(np.float64))
            cross = g.column(1)[0].as_py() != g.column(2)[0].as_py()
            near = x @ x.T >= threshold
            if cross:
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            links = near @ n
            forest = Forest(len(ids))
            forest.link(*np.nonzero(np.triu(near)))
            child = np.flatnonzero(forest.label != np.arange(len(ids)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(some), len(child)])), pa.array(np.r_[ids[some], ids[child]]), pa.array(np.r_[links[some], ids[forest.label[child]]].astype(np.int64))], schema=schema)

    out = cut(dealt.repartition(shuffle_width(spark), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "id").mapInArrow(run, "kind int, a long, b long"))
    return out.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links")), out.where("kind = 1").select("a", "b")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings (vec_id, embedding)."""
    rows = cut(usable(embeddings))
    h = ["h1", "h2"]
    found = rows.sparkSession.createDataFrame([], "h1 long, h2 long, n long, n_links long, component_id long")
    for d in dimensions(rows):
        found = found.union(_classes_linked(rows.where(F.col("d") == d), threshold, k))
    found = cut(found)
    known = spread_join(rows.select("vec_id", *h), found, h, "n", rows.count()).select(F.col("vec_id").alias("known"), *h, "n_links", "component_id")
    all_rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    all_rows = all_rows.select("vec_id", F.xxhash64("v").alias("r1"), F.xxhash64(F.lit(7), "v").alias("r2"))
    joined = all_rows.join(known, (F.col("vec_id") == F.col("known")) & (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2")), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _classes_linked(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """(h1, h2, n, n_links, component_id) of the classes of equal vectors of one dimension."""
    h = ["h1", "h2"]
    classes = cut(rows.groupBy(*h).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    schema = pa.schema([("id", pa.int64()), ("x", pa.binary())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(1)).astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], type=pa.binary())], schema=schema)

    # different vectors under one vec_id: the class is known by a number of its own
    named = cut(classes.withColumn("smallest", F.col("id")).withColumn("id", F.xxhash64(*h)))
    units = cut(named.select("id", "v").mapInArrow(single, "id long, x binary"))
    count = units.count()
    near = threshold - MARGIN
    graph, joins = descend(cut(_best_of(leaves(units, count, TREES, 0, k, near))), units, k, threshold)
    block = BLOCK
    for turn in range(1, AUDITS + 1):
        groups = grouped(joins, units, threshold, k)
        sample = units.orderBy(F.xxhash64(F.lit(turn), "id"), "id").limit(AUDIT).collect()
        if not sample:
            break
        lost, recall = missed(sample, units, groups, threshold)
        joins = joins.union(lost.select("u", "v"))
        if recall >= RECALL:
            if not lost.isEmpty():
                groups = grouped(joins, units, threshold, k)
            break
        if turn < AUDITS:
            graph, more = descend(cut(_best_of(graph.select("u", "v", "sim").union(leaves(units, count, TREES, turn, k, near)))), units, k, threshold)
            joins = joins.union(more)
    else:
        groups, block = units.select("id", F.lit(0).cast("long").alias("grp")), WHOLE
    links, forest = exact_links(groups.join(named, "id").select("grp", "id", "n", "v"), threshold, block)
    component = connected_components(forest, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("root"))
    whole = cut(named.join(component, "id", "left").join(links, "id", "left").select(*h, "n", "smallest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root"))
    alone = whole.where("root is null").select(*h, "n", "n_links", F.col("smallest").alias("component_id"))
    whole = whole.where("root is not null")
    least = whole.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("members"))
    return alone.union(spread_join(whole, least, ["root"], "members", whole.count()).select(*h, "n", "n_links", "component_id"))


def oracle_sql() -> str:
    """All pairs, and the smallest vec_id spread along the links."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.n WHERE c.r < l.b),
least AS (SELECT n, min(r) AS component_id FROM c GROUP BY n), links AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON n = vec_id LEFT JOIN links ON a = vec_id
"""
