"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

The network is trained in numpy by backpropagation through time. It reads UTF-8 bytes in windows of WINDOW, forwards and
backwards, and labels every position with class probabilities; a document's probabilities are the mean over all its
positions. Every window of every whole text is read.

Learning takes only text and non-null lang of documents with crc32(doc_id as text) mod 4 other than 2: about
`sample_per_class` documents of each language, chosen by a hash of doc_id (of several texts of one id the smallest), and of
each WINDOWS_PER_DOC windows at seeded places. Every language is learned; more than CLASSES are an error. Predictions see
the text alone, of any length; of equal probabilities the language first by name counts. Texts that are null or hold no
letter are `und` with score 0; so is every text if there is nothing to learn from. Null doc_ids count as the empty text for the remainder and are never learned from;
repeated rows are each predicted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import bounded_batches, id_remainder

HIDDEN = 8
WINDOW = 128
#: Bounds on what is learned from.
SAMPLE_PER_CLASS = 300
WINDOWS_PER_DOC = 6
#: More values of lang than a network of this kind can tell apart are taken for a mistake, not cut off.
CLASSES = 4_096
STEPS, BATCH, TRAIN_WINDOW, RATE = 700, 192, 64, 0.02
HELD_OUT_MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"
_WORD_CHAR = re.compile(r"[^\W\d_]")  # letters, and numbers such as one half
_BLOCK = 2048

Params = dict[str, np.ndarray]


def initial(classes: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)  # input weights and biases, by byte
        p[f"u{d}"] = rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, HIDDEN**-0.5, (classes, HIDDEN)).astype(np.float32)
    p["bias"] = np.zeros((classes, 1), np.float32)
    return p


def recur(x: np.ndarray, mask: np.ndarray, table: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (steps, HIDDEN, windows) of one direction; x and mask: (steps, windows). `keep` gets what the gradient needs."""
    steps, n = x.shape
    states = np.empty((steps, HIDDEN, n), np.float32)
    h = np.zeros((HIDDEN, n), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a, b = table[x[t]].T, u @ h
        gates = 1 / (1 + np.exp(-(a[: 2 * HIDDEN] + b[: 2 * HIDDEN])))
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        c = np.tanh(a[2 * HIDDEN :] + r * b[2 * HIDDEN :])
        new = (c + z * (h - c)) * mask[t]
        if keep is not None:
            keep.append((t, h, z, r, c, b[2 * HIDDEN :]))
        states[t] = h = new
    return states


def _unroll(keep: list, grad: np.ndarray, x: np.ndarray, mask: np.ndarray, u: np.ndarray, classes_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the byte table and of u, given those of the states."""
    d_table, d_u = np.zeros_like(classes_table), np.zeros_like(u)
    d_h = np.zeros_like(grad[0])
    for t, h, z, r, c, s in reversed(keep):
        d_new = (grad[t] + d_h) * mask[t]
        d_c = d_new * (1 - z) * (1 - c * c)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * s * r * (1 - r)
        d_in = np.concatenate([d_z, d_r, d_c])
        np.add.at(d_table, x[t], d_in.T)
        d_b = np.concatenate([d_z, d_r, d_c * r])
        d_u += d_b @ h.T
        d_h = d_new * z + u.T @ d_b
    return d_table, d_u


def probabilities(p: Params, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(steps, classes, windows)"""
    logits = p["of"] @ recur(x, mask, p["xf"], p["uf"], False) + p["ob"] @ recur(x, mask, p["xb"], p["ub"], True) + p["bias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[Params, float]:
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: recur(x, mask, p[f"x{d}"], p[f"u{d}"], d == "b", kept[d]) for d in "fb"}
    logits = p["of"] @ states["f"] + p["ob"] @ states["b"] + p["bias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob = e / e.sum(axis=1, keepdims=True)
    total = max(1.0, float(mask.sum()))
    loss = -float((np.log(prob[:, y, np.arange(len(y))] + 1e-9) * mask).sum()) / total
    d = prob.copy()
    d[:, y, np.arange(len(y))] -= 1
    d *= mask[:, None, :] / total
    out: Params = {"bias": d.sum(axis=(0, 2))[:, None].astype(np.float32)}
    for k in "fb":
        out[f"o{k}"] = np.einsum("tcn,thn->ch", d, states[k], optimize=True)
        out[f"x{k}"], out[f"u{k}"] = _unroll(kept[k], np.matmul(p[f"o{k}"].T, d), x, mask, p[f"u{k}"], p[f"x{k}"])
    return out, loss


def fit(windows: list[tuple[bytes, int]], classes: int, steps: int = STEPS, seed: int = 5) -> Params:
    """Adam over batches in which every class is as frequent."""
    rng = np.random.default_rng(seed)
    p = initial(classes, seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    by_class = [[w for w, c in windows if c == k] for k in range(classes)]
    present = [k for k in range(classes) if by_class[k]]
    for step in range(1, steps + 1):
        y = rng.choice(present, BATCH)
        x, mask = np.zeros((TRAIN_WINDOW, BATCH), np.uint8), np.zeros((TRAIN_WINDOW, BATCH), np.float32)
        for i, k in enumerate(y):
            w = by_class[k][rng.integers(len(by_class[k]))]
            at = rng.integers(max(1, len(w) - TRAIN_WINDOW + 1))
            w = w[at : at + TRAIN_WINDOW]
            x[: len(w), i], mask[: len(w), i] = np.frombuffer(w, np.uint8), 1
        g, _ = gradients(p, x, mask, y)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1 / max(size, 1e-9))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: Params, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text that isn't empty: mean class probabilities over its positions, and how often each class is a position's label."""
    classes = len(p["bias"])
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.full(len(flat), WINDOW)
    lengths[np.cumsum(counts) - 1] = sizes - (counts - 1) * WINDOW
    total, votes = np.zeros((len(texts), classes)), np.zeros((len(texts), classes))
    for a in range(0, len(flat), _BLOCK):
        x, n = np.ascontiguousarray(flat[a : a + _BLOCK].T), lengths[a : a + _BLOCK]
        mask = (np.arange(WINDOW)[:, None] < n).astype(np.float32)
        prob = probabilities(p, x, mask)
        top = prob.max(axis=1, keepdims=True)
        for k in range(classes):
            total[:, k] += np.bincount(owner[a : a + _BLOCK], (prob[:, k] * mask).sum(axis=0), len(texts))
            votes[:, k] += np.bincount(owner[a : a + _BLOCK], ((prob[:, k] == top[:, 0]) * mask).sum(axis=0), len(texts))
    return total / sizes[:, None], votes / sizes[:, None]


def train(docs: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], Params | None]:
    usable = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", HELD_OUT_MODULUS) != HELD_OUT))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(CLASSES + 1).collect()  # a bounded list of classes
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} languages")
    if not counts:
        return [], None
    names = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], sample_per_class / r["n"])])
    chosen = usable.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30)))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("part", pa.binary())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "replace")
                rng = np.random.default_rng([doc_id & 0x7FFFFFFF, len(data)])
                for at in rng.integers(0, max(1, len(data) - WINDOW + 1), WINDOWS_PER_DOC if len(data) > WINDOW else 1):
                    rows.append((doc_id, lang, data[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), arrow, strict=True)], schema=arrow)

    bounded_batches(docs.sparkSession)
    got = sorted((r["doc_id"], bytes(r["part"]), names.index(r["lang"])) for r in chosen.select("doc_id", "lang", "text").mapInArrow(windows, "doc_id long, lang string, part binary").collect() if len(r["part"]))
    return names, fit([g[1:] for g in got], len(names)) if got else None


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, labelled_share double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("labelled_share", pa.float64())])


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD_CHAR.finditer(text))


def predict(names: list[str], p: Params | None, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, mean probability, share of positions with that label) of each text."""
    out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    live = [i for i, t in enumerate(texts) if p is not None and t and has_letter(t)]
    at = 0
    while at < len(live):  # about four million bytes at a time, or one longer text
        some, size = [], 0
        while at < len(live) and size < 4_000_000:
            some.append(texts[live[at]].encode("utf-8", "replace"))
            size += len(some[-1])
            at += 1
        mean, votes = pooled(p, some)
        best = mean.argmax(axis=1)
        for j, k in enumerate(best):
            out[live[at - len(some) + j]] = (names[k], float(min(1.0, max(0.0, mean[j, k]))), float(votes[j, k]))
    return out


def language(docs: DataFrame, model: tuple[list[str], Params | None] | None = None) -> DataFrame:
    """A prediction for every row of docs (doc_id, text), learned from docs (lang) unless a model is given."""
    names, p = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast((names, p))  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = predict(*sent.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], type=ARROW.field(k + 2).type) for k in range(3))], schema=ARROW)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").select("doc_id", (id_remainder("doc_id", HELD_OUT_MODULUS) == HELD_OUT).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def recognised(docs: DataFrame, model: tuple[list[str], Params | None], least: float) -> DataFrame:
    """The rows of docs, with their columns, whose text has a language of at least this mean probability.

    Without a model, as nothing was there to learn from, those whose text holds a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            if sent.value[1] is None:
                yield b.filter(pa.array([bool(t) and has_letter(t) for t in texts], type=pa.bool_()))
                continue
            found = predict(*sent.value, texts)
            yield b.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], type=pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
