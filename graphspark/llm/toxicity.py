"""Toxicity by FTRL-proximal logistic regression (operator 3).

A text becomes the set of hashed features of its words: single words, pairs of neighbours, and skip-grams with one word
left out between. Weights are learned by FTRL-proximal with per-coordinate rates; L1 keeps few of them, so that the model
is a short list of (index, weight) that is sent to every task. Whole texts are scored.

Learning takes only rows of `labels` with a toxic value whose crc32(doc_id as text) mod 5 is not 0, and of those about
`sample_per_class` of each class at most (chosen by a hash of doc_id); of several labels of a doc_id the larger counts, of
several texts the smallest, and of a text with more than `features_per_doc` features so many by a hash. A document's score
never sees labels, lang, source or doc_id. A null or empty text has no features and scores by the bias alone; a very long
one is scored whole. Null doc_ids count as the empty text for the remainder and are never learned from; repeated rows are
each scored; where nothing can be learned every score is UNLEARNED, so 0 is predicted; equal scores need no order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import bounded_batches, id_remainder

BITS = 20
HELD_OUT_MODULUS = 5
#: Bound on the labelled documents of each class that are learned from.
SAMPLE_PER_CLASS = 4_000
#: Bound on the features of one of them.
FEATURES_PER_DOC = 16_384
#: The score of every text where there are no labels to learn from.
UNLEARNED = 0.0
#: Features that fewer sampled documents hold are not learned.
LEAST_DOCS = 3
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0

_WORD = re.compile(r"[^\W\d_]+")
_MASK = np.uint64((1 << BITS) - 1)
_WORDS_KEPT = 200_000


class _Words(dict):
    """Word hashes, remembered in each worker up to a bound."""

    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        return h


_words = _Words()


def features(text: str, kept: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature indices of a text; with `kept`, only those it marks."""
    if len(_words) > _WORDS_KEPT:
        _words.clear()
    found = _WORD.findall(text.lower())
    w = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    grams = [w]
    for step, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        grams.append((w[:-step] * np.uint64(0x100000001B3) ^ w[step:] * np.uint64(salt)) if len(w) > step else w[:0])
    g = np.concatenate(grams)
    g = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & _MASK
    if kept is not None:
        g = g[kept[g]]
    return np.unique(g).astype(np.uint32)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by index and the bias. Examples hold distinct indices below `size`."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(z[i]) <= L1] = 0
        return w

    rows = [np.append(e, size).astype(np.int64) for e in examples]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            w[-1] = -z[-1] * ALPHA / (BETA + np.sqrt(n[-1]))  # the bias is not regularised
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    out = weights(np.arange(size))
    return out, float(-z[-1] * ALPHA / (BETA + np.sqrt(n[-1])))


def sampled(found: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the sorted features, those with the smallest hashes."""
    if len(found) <= most:
        return found
    h = (found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return found[np.sort(np.argsort(h, kind="stable")[:most])]


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, features_per_doc: int = FEATURES_PER_DOC) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights that are not zero, and the bias: minus infinity where nothing can be learned."""
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_remainder("doc_id", HELD_OUT_MODULUS) != 0))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(sample_per_class / n)).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    arrow = pa.schema([("toxic", pa.int32()), ("indices", pa.binary())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sampled(features(t or ""), features_per_doc).tobytes() for t in b.column(0).to_pylist()], type=pa.binary())], schema=arrow)

    bounded_batches(docs.sparkSession)
    # The chosen ids are at most about 2 x sample_per_class: a bounded broadcast.
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").mapInArrow(run, "toxic int, indices binary")
    rows = sorted((bytes(r["indices"]), r["toxic"]) for r in sample.toLocalIterator())
    examples, y = [np.frombuffer(r[0], np.uint32) for r in rows], np.array([r[1] for r in rows], float)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    seen = np.zeros(1 << BITS, np.int32)
    for e in examples:
        seen[e] += 1
    kept = np.flatnonzero(seen >= min(LEAST_DOCS, len(examples)))
    place = np.full(1 << BITS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    w, bias = ftrl([(p := place[e])[p >= 0] for e in examples], y, len(kept))
    alive = np.flatnonzero(w)
    # The score is the probability under equal classes: both kinds of error weigh alike however rare label 1 is.
    odds = np.log((len(y) - y.sum()) / y.sum()) if 0 < y.sum() < len(y) else 0.0
    return kept[alive], w[alive], bias + float(odds)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """A score for every row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    index, weight, bias = train(docs, labels, sample_per_class)
    model = docs.sparkSession.sparkContext.broadcast((index, weight, bias))  # L1 leaves far fewer than 2**BITS weights
    ready: list = []

    def run(batches):
        if not ready:
            i, w, b = model.value
            kept, dense = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
            kept[i], dense[i] = True, w
            ready.extend((kept, dense, b))
        kept, dense, b = ready
        for batch in batches:
            if np.isinf(b):
                score = [UNLEARNED] * batch.num_rows
            else:
                score = [1 / (1 + np.exp(-np.clip(dense[features(t or "", kept)].sum() + b, -35, 35))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, type=pa.float64()), pa.array([int(s >= 0.5) for s in score], type=pa.int32())], schema=ARROW)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").select("doc_id", (id_remainder("doc_id", HELD_OUT_MODULUS) == 0).alias("held_out"), "text").mapInArrow(run, SCHEMA)
