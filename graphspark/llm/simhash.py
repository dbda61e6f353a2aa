"""SimHash near-duplicates by a binary trie self-join (operator 10).

Fingerprints are 64 bits over the XXH64 values (seed 42) of a text's 4-word shingles. Two fingerprints link at
`budget` or fewer differing bits. Of budget + 1 blocks of bits at least one is then equal, so the distinct fingerprints
are dealt once for each block by that block's value. In each share the fingerprints, rotated so that the block leads,
form a binary trie: pairs of nodes are traversed together from equal leading blocks down, differing bits add up, and a
pair of nodes is left as soon as they exceed the budget; small node pairs are compared outright. A share yields only the
edges of its own spanning forest, so groups of copies never become all their pairs.

Shares above `hot` fingerprints are dealt again: of budget + 1 blocks of the bits that are left one is equal too, so each
becomes shares that agree in two blocks, at a fixed cost however many rows there are. What is still above `hot`, such as
many fingerprints around one, is split by a hash, and every pair of parts is its own share, which keeps the join whole.

`near_duplicates` is that over 64 bits and 4 of them differing. `deduplicated` groups texts by similarity: a pair of 0.8
differs in ten of 64 bits, which no budget tells from chance, so it uses wide signatures, tries over parts of them to bring
pairs together, and all of their bits to decide.

A null or empty text has fingerprint zero and links like any other; a very long one is hashed whole, its bits counted in
pieces. A bit that is set in just half of the hashes is 0. component_id is the smallest doc_id reachable; null
doc_ids don't count towards it, and it is null only if the whole component has none. Repeated rows each get their row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import bounded_batches
from graphspark.operators.components import connected_components
from graphspark.operators.joins import spread_join
from graphspark.session import cut, shuffle_width

SHINGLE = 4
BUDGET = 4
#: Distinct fingerprints of one block value beyond which its share is split.
HOT = 4_096
#: Rows that one task of the join holds at about most.
TASK_ROWS = 1_000_000
_SMALL = 1_024
_CHUNK = 200_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, repeats included; of the whole sequence if it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 20 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    if n < shingle:
        starts, stops = [0], [len(line)]
    else:
        starts, stops = starts[: n - shingle + 1], (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64, count=len(starts))


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of h (n, words), as words."""
    counts = np.zeros(64 * h.shape[1], np.int64)
    for a in range(0, len(h), 255):  # so many bytes of 1 add up in a byte
        counts += np.add.reduce(np.unpackbits(h[a : a + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    h = shingle_hashes(text, SHINGLE)
    return int(majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def blocks(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks of so many bits."""
    edges = [bits * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _turned(x: np.ndarray, by: int, bits: int) -> np.ndarray:
    """x with its last `bits` bits rotated to the left."""
    if not by:
        return x
    below = np.uint64((1 << bits) - 1)
    rest = x & below
    return (x & ~below) | ((rest << np.uint64(by)) & below) | (rest >> np.uint64(bits - by))


class Forest:
    """Smallest reachable index of each of n items."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def trie_join(keys: np.ndarray, lead: int, budget: int, forest: Forest, side: np.ndarray | None = None, bits: int = 64, near: Near | None = None) -> None:
    """Link all keys (sorted uint64) that agree in their `lead` top bits and differ in at most `budget` others of the top `bits`.

    With `side`, keys of equal sides needn't be compared: another share does that. With `near`, a rule on arrays of indices,
    only pairs that it holds for are linked. Pairs of nodes whose keys are all in one component by now are left alone.
    """
    if len(keys) < 2:
        return
    top = keys >> np.uint64(64 - lead)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    many = ends - starts > 1
    roots = (starts[many], ends[many])
    # copies first: each against the first of those with the same key
    same = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = np.repeat(same, np.diff(np.r_[same, len(keys)]))
    rest = np.flatnonzero(first != np.arange(len(keys)))
    _link(first[rest], rest, forest, near)
    stack = [(lead, *roots, *roots, np.zeros(many.sum(), np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        run = np.cumsum(np.r_[True, forest.label[1:] != forest.label[:-1]])  # ranges within one run are of one component
        open_ = (run[al] != run[ah - 1]) | (run[bl] != run[bh - 1]) | (forest.label[al] != forest.label[bl])
        al, ah, bl, bh, err = (x[open_] for x in (al, ah, bl, bh, err))
        small = ((ah - al) * (bh - bl) <= _SMALL) | (depth >= bits)
        if small.any():
            _compare(keys, al[small], ah[small], bl[small], bh[small], budget, forest, side, bits, near)
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        if len(al) > _CHUNK:
            stack += [(depth, *(x[k : k + _CHUNK] for x in (al, ah, bl, bh, err))) for k in range(0, len(al), _CHUNK)]
            continue
        bit = np.uint64(1 << (63 - depth))
        above = ~np.uint64((1 << (64 - depth)) - 1)  # the bits of the path so far
        am, bm = (np.searchsorted(keys, (keys[x] & above) | bit) for x in (al, bl))
        same = al == bl
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~same] for x in (am, ah, bl, bm, err + 1))]
        nxt = [np.concatenate(x) for x in zip(*children, strict=True)]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        stack.append((depth + 1, *(x[live] for x in nxt)))


def _link(i: np.ndarray, j: np.ndarray, forest: Forest, near: Near | None) -> None:
    """Link the pairs that `near` holds for; those in one component by now aren't looked at."""
    if near is not None:
        apart = forest.label[i] != forest.label[j]
        i, j = i[apart], j[apart]
        ok = near(i, j)
        i, j = i[ok], j[ok]
    forest.link(i, j)


def _compare(keys: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int, forest: Forest, side: np.ndarray | None, bits: int, near: Near | None) -> None:
    """Every key of each first range against every key of its second."""
    width, sizes = bh - bl, (ah - al) * (bh - bl)
    cuts = np.r_[np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 21))) + 1, len(sizes)]
    shift = np.uint64(64 - bits)
    at = 0
    for to in cuts:
        s, w = sizes[at:to], width[at:to]
        which = np.repeat(np.arange(at, to), s)
        offset = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        wide = np.repeat(w, s)
        i, j = al[which] + offset // wide, bl[which] + offset % wide
        ok = (i < j) | (al[which] != bl[which])
        ok &= np.bitwise_count((keys[i] ^ keys[j]) >> shift) <= budget
        if side is not None:
            ok &= side[i] != side[j]
        _link(i[ok], j[ok], forest, near)
        at = to


def _bits(c: str, first: int, width: int) -> Column:
    """`width` bits of a long from `first` on, counted from the top."""
    return F.shiftrightunsigned(F.shiftleft(c, first), 64 - width)


def _deal(distinct: DataFrame, budget: int, hot: int) -> tuple[DataFrame, int]:
    """(fp, block, value, sub, subvalue, ways) of shares of two rows or more, and about how many rows; sub is -1 where a
    share agrees in one block only."""
    plan = blocks(budget)
    parts = [F.struct(F.lit(k).cast("int").alias("block"), _bits("fp", a, w).alias("value")) for k, (a, w) in enumerate(plan)]
    dealt = distinct.select("fp", F.inline(F.array(*parts)))
    # at most as many rows as blocks have values
    shares = cut(dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    crowd = shares.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > hot, F.col("n"))), F.lit(0)).alias("hot")).first()
    once = dealt.join(shares.where(F.col("n") <= hot).select("block", "value"), ["block", "value"])
    once = once.select("fp", "block", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue"), F.lit(1).alias("ways"))
    if not crowd["hot"]:
        return once, crowd["rows"]
    subs = F.lit(None)
    for k, (a, w) in enumerate(plan):
        turned = F.shiftleft("fp", a + w) if a + w < 64 else F.lit(0).cast("long")
        turned = turned.bitwiseOR(F.shiftleft(_bits("fp", 0, a), w)) if a else turned  # the bits after the block, then those before it
        sub = [F.struct(F.lit(j).alias("sub"), F.shiftrightunsigned(F.shiftleft(turned, at), 64 - v).alias("subvalue")) for j, (at, v) in enumerate(blocks(budget, 64 - w))]
        subs = F.when(F.col("block") == k, F.array(*sub)).otherwise(subs)
    twice = dealt.join(shares.where(F.col("n") > hot).select("block", "value"), ["block", "value"]).select("fp", "block", "value", F.inline(subs))
    key = ["block", "value", "sub", "subvalue"]
    ways = twice.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("ways"))
    twice = twice.join(ways, key).select("fp", *key, "ways")
    return once.union(twice), crowd["rows"] + budget * crowd["hot"]


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (fp) whose components are those of all links."""
    spark = distinct.sparkSession
    shares, rows = _deal(distinct, budget, hot)
    own = F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")
    other = F.explode(F.when(F.col("ways") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("ways") - 1))).alias("other")
    key = ["block", "value", "sub", "subvalue"]
    shares = shares.select("fp", *key, own.alias("own"), other).select("fp", *key, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    width = max(shuffle_width(spark), -(-rows // TASK_ROWS))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    plan = blocks(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        fp, block, sub, own, lo, hi = (table.column(c).to_numpy() for c in ("fp", "block", "sub", "own", "lo", "hi"))
        fp = fp.view(np.uint64)
        # shares of one kind are joined at once: their values part them
        kind = ((sub.astype(np.int64) + 1) * 8 + block) << 48 | lo.astype(np.int64) << 24 | hi
        for s in np.unique(kind):
            mine = np.flatnonzero(kind == s)
            k = int(s) >> 48
            first, lead = plan[k % 8]
            turned = _turned(fp[mine], first, 64)
            if k >= 8:
                at, more = blocks(budget, 64 - lead)[k // 8 - 1]
                turned = _turned(turned, at, 64 - lead)
                lead += more
            order = np.argsort(turned, kind="stable")
            pairwise = (int(s) >> 24) & 0xFFFFFF != int(s) & 0xFFFFFF
            forest = Forest(len(mine))
            trie_join(turned[order], lead, budget, forest, own[mine][order] if pairwise else None)
            child = np.flatnonzero(forest.label != np.arange(len(mine)))
            if len(child):
                ids = fp[mine][order].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[forest.label[child]])], schema=schema)

    return shares.repartition(width, *key, "lo", "hi").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")))
    roots = cut(connected_components(links(distinct.select("fp"), budget), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root")))
    alone = distinct.join(roots, "fp", "left_anti").select("fp", F.col("first_doc").alias("component_id"), "n")
    rooted = cut(distinct.join(roots, "fp"))
    groups = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("members"))
    grouped = spread_join(rooted.select("fp", "n", "root"), groups, ["root"], "members", rooted.count()).select("fp", "component_id", "n")
    by_fp = cut(alone.union(grouped))
    out = spread_join(prints, by_fp, ["fp"], "n", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- groups of similar texts: wide signatures

#: Words of a shingle and similarity (Jaccard, of the sets of shingles) of near-duplicates.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a signature at least.
WIDE = 16
#: Bits by which the keys of a table may differ, and the share of similar pairs that some table must bring together.
KEY_BUDGET, FOUND = 2, 0.99
#: Bits of a key below the logarithm of the number of texts: a text meets about as many others by chance as the square of the rest.
KEY_SHORT = 2
#: Standard errors that a signature may be off.
ERRORS = 1.64
#: Rows that one task of this join holds at about most, and of a share that isn't split.
WIDE_TASK_ROWS, WIDE_HOT = 200_000, (1_024, 131_072)


def differing(similarity: float) -> float:
    """The most that two texts of this similarity differ, as the chance that a bit does: sets of one size differ most."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tables(count: int, similarity: float) -> tuple[int, int]:
    """(bits of a key, number of tables) for so many texts: keys grow with the logarithm of the texts, tables with the keys."""
    p = differing(similarity)
    bits = min(62, max(12, int(count).bit_length() - KEY_SHORT))
    met = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(KEY_BUDGET + 1))
    return bits, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - met)))


def signature(text: str | None, words: int, shingle: int = WIDE_SHINGLE) -> bytes:
    """SimHash over the set of shingles with 64 x `words` bits; of a text without words all bits are 0."""
    h = np.unique(shingle_hashes(text, shingle))
    if not len(h):
        return bytes(8 * words)
    x = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return majority(x ^ (x >> np.uint64(31))).tobytes()


def _keys(signatures: np.ndarray, table: int, bits: int, first: int, lead: int) -> np.ndarray:
    """The bits of a table's key, those of the block [first, first + lead) in front, at the top of a word."""
    at, to = table * bits // 8, -(-(table + 1) * bits // 8)
    own = np.unpackbits(np.ascontiguousarray(signatures.view(np.uint8)[:, at:to]), axis=1, bitorder="little")[:, table * bits - 8 * at :][:, :bits]
    out = np.zeros((len(own), 64), np.uint8)
    out[:, :bits] = np.concatenate([own[:, first : first + lead], own[:, :first], own[:, first + lead :]], axis=1)
    return np.packbits(out, axis=1).view(">u8")[:, 0].astype(np.uint64)


def similar_links(classes: DataFrame, count: int, similarity: float, hot: int | None = None) -> DataFrame:
    """Edges (a, b) between classes (id, sig) whose components are those of all pairs that a table brings together and that
    differ in no more bits than texts of this similarity do.

    A table's key is a part of the signature. Keys that differ in up to KEY_BUDGET bits agree in one of KEY_BUDGET + 1
    blocks: classes are dealt by table and block, and each share is a trie self-join, as for fingerprints. Shares above
    `hot` (by default twice what is even, within WIDE_HOT) are split by a hash into parts, and every pair of parts is a share.
    """
    spark = classes.sparkSession
    bits, count_tables = tables(count, similarity)
    plan = blocks(KEY_BUDGET, bits)
    hot = hot or min(max(2 * count >> min(w for _, w in plan), WIDE_HOT[0]), WIDE_HOT[1])
    dealt_schema = pa.schema([("kind", pa.int32()), ("value", pa.int64()), ("id", pa.int64()), ("sig", pa.binary())])
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = words(b.column(1))
                for t in range(count_tables):
                    for k, (first, lead) in enumerate(plan):
                        value = (_keys(sig, t, bits, first, lead) >> np.uint64(64 - lead)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t * len(plan) + k, np.int32)), pa.array(value), b.column(0), b.column(1)], schema=dealt_schema)

    dealt = classes.select("id", "sig").mapInArrow(deal, "kind int, value long, id long, sig binary")
    key = ["kind", "value"]
    crowded = cut(classes.select("id", "sig").mapInArrow(deal, "kind int, value long, id long, sig binary").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("ways")))
    shares = dealt.join(F.broadcast(crowded), key, "left")  # at most rows / hot of them
    ways = F.coalesce("ways", F.lit(1))
    shares = shares.select(*key, F.pmod(F.xxhash64("id"), ways).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), ways - 1)).alias("other"), "id", "sig")
    shares = shares.select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "sig")
    width = max(shuffle_width(spark), -(-count * count_tables * len(plan) // WIDE_TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        kind, lo, hi, own, ids = (table.column(c).to_numpy() for c in ("kind", "lo", "hi", "own", "id"))
        signatures = words(table.column("sig"))
        size = 64 * signatures.shape[1]
        p = differing(similarity)
        most = size * p + ERRORS * np.sqrt(size * p * (1 - p))
        share = kind.astype(np.int64) << 48 | lo.astype(np.int64) << 24 | hi
        for s in np.unique(share):
            mine = np.flatnonzero(share == s)
            first, lead = plan[(int(s) >> 48) % len(plan)]
            keys = _keys(signatures[mine], (int(s) >> 48) // len(plan), bits, first, lead)
            mine = mine[order := np.argsort(keys, kind="stable")]
            sig = signatures[mine]

            def near(i: np.ndarray, j: np.ndarray, sig=sig) -> np.ndarray:
                return np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64) <= most

            pairwise = (int(s) >> 24) & 0xFFFFFF != int(s) & 0xFFFFFF
            forest = Forest(len(mine))
            trie_join(keys[order], lead, KEY_BUDGET, forest, own[mine] if pairwise else None, bits, near)
            child = np.flatnonzero(forest.label != np.arange(len(mine)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine][child]), pa.array(ids[mine][forest.label[child]])], schema=edge_schema)

    return shares.repartition(width, *key, "lo", "hi").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """The rows of docs, with their columns, that have the smallest doc_id of their group; of repeated rows one stays.

    Texts link whose sets of `shingle`-word shingles have a Jaccard similarity of `similarity` or more, as their signatures
    tell: 1,024 bits give it with a standard error of about 0.03 at 0.8, and pairs within ERRORS of that link. Tables of
    keys bring FOUND of the pairs that are just as similar together, and more of those that are more so. A null text is an
    empty one, and all texts without words are one group; null doc_ids come after all others; equal texts are one class
    before anything is compared; a row is known by its doc_id and a hash of its text, so texts are dealt once.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")]
    bits, count_tables = tables(total := docs.count(), similarity)
    words = max(WIDE, -(-bits * count_tables // 64))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([signature(t, words, shingle) for t in b.column(2).to_pylist()], type=pa.binary())], schema=schema)

    bounded_batches(docs.sparkSession)
    prints = cut(docs.select(*key, "text").mapInArrow(run, "doc_id long, mark long, sig binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    classes = cut(prints.groupBy(F.xxhash64("sig").alias("id")).agg(first, F.min("sig").alias("sig")))
    roots = connected_components(similar_links(classes, total, similarity), "a", "b")
    rooted = classes.select("id", "first").join(roots.select(F.col("node").alias("id"), "component"), "id", "left").select("first", F.coalesce("component", "id").alias("root"))
    best = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.none", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.mark"))
    same = ["__none", "__id", "__mark"]
    kept = best.toDF("__none", "__id", "__mark")
    marked = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__mark": F.xxhash64("text")})
    # dropping repeated rows needs the same keys together as the join: texts are dealt once
    return marked.join(kept, same, "left_semi").dropDuplicates(same).select(docs.columns)
