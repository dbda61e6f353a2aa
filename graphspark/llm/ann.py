"""Approximate nearest neighbours by cross-polytope hashing (operator 9).

Fast Hadamard pseudo-rotations (three rounds of random signs and a Hadamard transform) turn each vector; its bucket in a
table is the nearest signed axis. Where that leaves more than about ROWS rows to a bucket, hashes are joined: each further
rotation multiplies the buckets by its signed axes, the last one by those of its first coordinates only, so that buckets
keep their size as the table grows. A query probes the buckets in the order of how far it is from their axes, and each
bucket's rows are compared with the queries that probe it by exact Euclidean distance in double precision. How many
buckets are probed comes from an audit: a bounded sample of queries is answered by brute force, and the fewest probes are
taken that reach `recall` of the true neighbours. Queries left with too few neighbours are answered over every bucket.

Every row is indexed. Of vectors with equal components only the k + 1 smallest vec_ids can be among a query's k nearest,
so only these go on. Buckets of over four times an even share (within BLOCK) are split into blocks of that size, which are
held one at a time while the queries stream past; nothing but the audit's sample and the list of crowded buckets (at most tables x rows / 256) goes to the driver.

Each dimension is a search of its own. Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do null vec_ids. Of equal distances the smaller vec_id comes first. Rows that repeat a vec_id with an equal vector
count once; different vectors under one vec_id are candidates of their own, and as a query the smallest of them asks. With
fewer than k others all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.llm.vectors import dimensions, matrix, salt, usable
from graphspark.session import cut, shuffle_width

K = 10
TABLES = 4
BLOCK = 256, 4_096
#: Rows of a bucket that the number of joined hashes aims at.
ROWS = 1_024
#: Queries of the audit, and the recall it aims at.
AUDIT = 128
RECALL = 0.98
SEED = 11
#: Crowded buckets that are broadcast at most.
CROWDED = 1_000_000
COPY_SALTS = 64


class Polytope:
    """The signed axes of `tables` times one or more pseudo-rotations of d dimensions: at least `buckets` of them a table."""

    def __init__(self, d: int, tables: int = TABLES, seed: int = SEED, buckets: int = 1):
        self.d, self.tables = d, tables
        self.width = 1 << max(0, d - 1).bit_length()
        self.axes = [self.width]  # coordinates that each of the joined hashes looks at
        while (got := self.buckets) < buckets:
            self.axes.append(min(self.width, 1 << max(0, -(-buckets // (2 * got)) - 1).bit_length()))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (len(self.axes), tables, 3, self.width))

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=object))

    def turned(self, x: np.ndarray, table: int, level: int = 0) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.d] = x / np.abs(x).max(axis=1, keepdims=True)
        for signs in self.signs[level, table]:
            y *= signs
            h = 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), self.width)
                h *= 2
        return y

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for level, axes in enumerate(self.axes):
            y = self.turned(x, table, level)[:, :axes]
            axis = np.abs(y).argmax(axis=1)
            code = code * (2 * axes) + axis + axes * (y[np.arange(len(x)), axis] < 0)
        return code

    def order(self, x: np.ndarray, table: int, most: int | None = None) -> np.ndarray:
        """The nearest `most` buckets of each row (or all), by the sum of squared gaps to the nearest axes."""
        most = min(most or self.buckets, self.buckets)
        return np.concatenate([self._order(x[a : a + 64], table, most) for a in range(0, len(x), 64)]) if len(x) else np.zeros((0, most), np.int64)

    def _order(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        code, loss, row = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1)), np.arange(len(x))[:, None]
        for level, axes in enumerate(self.axes):
            y = self.turned(x, table, level)
            y = y[:, :axes] / np.sqrt((y * y).sum(axis=1, keepdims=True))
            gap = (np.abs(y).max(axis=1, keepdims=True) - np.hstack((y, -y))) ** 2
            loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :most]  # what is among the best whole buckets is so in its first hashes
            code, loss = code[row, best], loss[row, best]
        return code


def _distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of pairs of rows; scaled where squares would overflow or vanish."""
    diff = q - c
    with np.errstate(over="ignore", invalid="ignore"):
        square = (diff * diff).sum(1)
    out = np.sqrt(square)
    odd = ~((square > 1e-280) & (square < 1e300))
    if odd.any():
        with np.errstate(over="ignore"):
            half = q[odd] / 2 - c[odd] / 2  # the difference itself may overflow
            top = np.abs(half).max(axis=1, initial=0)
            size = np.where(top > 0, top, 1.0)[:, None]
            out[odd] = 2 * top * np.sqrt(((half / size) ** 2).sum(1))
    return out


def nearest(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of c and exact distance of the k nearest of each q among c, its own id left out."""
    own = q_ids[:, None] == c_ids[None, :]
    sizes = np.concatenate([np.abs(q).max(axis=1), np.abs(c).max(axis=1)])
    high, low = sizes.max(initial=0.0), sizes.min(initial=np.inf)
    if len(c) <= k + 1:
        near = ~own
    elif high < 1e140 and low > 1e-130 and high < 1e60 * low:
        square = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)
        square[own] = np.inf
        slack = 1e-9 * ((q * q).sum(1)[:, None] + (c * c).sum(1).max())
        near = (square <= np.partition(square, k - 1, axis=1)[:, k - 1 : k] + slack) & ~own
    else:  # squares of such numbers overflow, vanish or drown each other: pair by pair
        near = np.zeros(own.shape, bool)
        for r in range(len(q)):
            d = _distance(np.broadcast_to(q[r], c.shape), c)
            others = d[~own[r]]
            near[r] = ~own[r] & (d <= np.partition(others, min(k, len(others)) - 1)[min(k, len(others)) - 1]) if len(others) else False
    i, j = np.nonzero(near)
    dist = _distance(q[i], c[j])
    by = np.lexsort((c_ids[j], dist, i))
    i, j, dist = i[by], j[by], dist[by]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], dist[keep]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found(q_ids: np.ndarray, c_ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(c_ids), pa.array(score)], schema=FOUND)


def _placed(rows: DataFrame, index: Polytope, probes: int) -> DataFrame:
    """(vec_id, v, place) with place = table * buckets + bucket; for each of the `probes` nearest, or the own one if 0."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1)).astype(np.float64)
            for t in range(index.tables):
                got = index.order(x, t, probes) if probes else index.bucket(x, t)[:, None]
                n = got.shape[1]
                who = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who).cast(pa.list_(pa.float64())), pa.array((got + t * index.buckets).ravel())], schema=schema)

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, place long")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, candidates: DataFrame, count: int, index: Polytope, probes: int, k: int) -> DataFrame:
    """The k nearest of each query among the `count` candidates that are in the buckets it probes."""
    block = min(max(4 * count // index.buckets, BLOCK[0]), BLOCK[1])
    spark = candidates.sparkSession
    rows = cut(_placed(candidates, index, 0))
    crowded = cut(rows.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > block).select("place", F.ceil(F.col("n") / block).cast("int").alias("ways")))
    crowded = F.broadcast(crowded) if crowded.count() <= CROWDED else crowded
    ways = F.coalesce("ways", F.lit(1))
    held = rows.join(crowded, "place", "left").select("place", salt(ways, "vec_id").alias("salt"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = _placed(queries, index, probes).join(crowded, "place", "left")
    asked = asked.select("place", F.explode(F.sequence(F.lit(0), ways - 1)).alias("salt"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            place, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            asks = b.column(2).to_numpy(zero_copy_only=False)
            vec_id, x = b.column(3).to_numpy(), matrix(b.column(4)).astype(np.float64)
            edges = np.r_[np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]), len(place)]
            for a, z in zip(edges, edges[1:], strict=False):
                if (place[a], part[a]) != now:
                    now, ids, vs = (place[a], part[a]), [], []
                if not asks[a]:
                    ids.append(vec_id[a:z])
                    vs.append(x[a:z])
                elif ids:
                    ids, vs = [np.concatenate(ids)], [np.concatenate(vs)]
                    for s in range(a, z, 512):
                        e = min(z, s + 512)
                        i, j, d = nearest(x[s:e], vec_id[s:e], vs[0], ids[0], k)
                        yield _found(vec_id[s:e][i], ids[0][j], d)

    dealt = held.union(asked).repartition(shuffle_width(spark), "place", "salt").sortWithinPartitions("place", "salt", "asks")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def brute(sample: list, candidates: DataFrame, k: int) -> DataFrame:
    """Exact answers for a bounded list of (vec_id, v)."""
    ids, q = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample])
    sent = candidates.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if b.num_rows:
                c_ids = b.column(0).to_numpy()
                i, j, d = nearest(q, ids, matrix(b.column(1)).astype(np.float64), c_ids, k)
                yield _found(ids[i], c_ids[j], d)

    return candidates.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def probes_needed(queries: DataFrame, candidates: DataFrame, index: Polytope, k: int, recall: float = RECALL) -> int:
    """The fewest probes that find `recall` of the true neighbours of the audit's queries."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDIT).collect()
    truth = _top(brute(sample, candidates, k), k).select("query_id", "vec_id").join(candidates.select("vec_id", "v"), "vec_id").collect()
    if not truth:
        return index.buckets
    asked = {r["vec_id"]: r["v"] for r in sample}
    q, c = np.array([asked[r["query_id"]] for r in truth]), np.array([r["v"] for r in truth])
    due, most = min(len(truth) - 1, int(np.ceil(recall * len(truth)))), 256
    while True:
        place = np.full(len(truth), most)
        for t in range(index.tables):
            hit = index.order(q, t, most) == index.bucket(c, t)[:, None]
            place = np.minimum(place, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        if (need := int(np.sort(place)[due])) < most or most >= index.buckets:
            return min(need + 1, index.buckets)
        most *= 4


def neighbours(embeddings: DataFrame, every: int = 100, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score for the rows of embeddings (vec_id, embedding) whose vec_id `every` divides."""
    rows = cut(usable(embeddings))
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in dimensions(rows):
        out = out.union(_neighbours(rows.where(F.col("d") == d), d, every, k, recall))
    return out


def _neighbours(rows: DataFrame, d: int, every: int, k: int, recall: float) -> DataFrame:
    """The same within one dimension."""
    # equal vectors: the k + 1 smallest ids, in two steps so that no key is ever large
    h = ["h1", "h2"]
    part = rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(COPY_SALTS)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy(*h, "s").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    candidates = cut(part.withColumn("r", F.row_number().over(Window.partitionBy(*h).orderBy("vec_id"))).where(F.col("r") <= k + 1).select("vec_id", "v"))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    if queries.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = candidates.count()
    index = Polytope(d, buckets=-(-count // ROWS))
    probes = probes_needed(queries, candidates, index, k, recall)
    found = cut(_top(search(queries, candidates, count, index, probes, k), k))
    due = min(k, rows.select("vec_id").distinct().count() - 1)
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")), queries["vec_id"] == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < due).select("vec_id", "v")
    if due > 0 and not short.isEmpty():
        exact = Polytope(d, tables=1)
        again = _top(search(short, candidates, count, exact, exact.buckets, k), k)
        found = found.join(again.select("query_id").distinct(), "query_id", "left_anti").select(*again.columns).union(again)
    return found
