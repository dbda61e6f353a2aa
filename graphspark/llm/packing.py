"""Hierarchical multi-length packing (operator 5).

Every document becomes token ids plus one closing id. Full context windows are cut off first; what is left of a
document goes to the smallest context tier that holds it. Tiers are packed from the longest down: a remainder opens a
window of its tier, the gap is filled with the largest whole remainders of shorter tiers that fit, and the last gap by
cutting one shorter remainder. So each window is full; the few tokens left at the end of a partition are cut into
windows whose lengths are powers of two, which need no padding. Step groups hold `step_tokens` tokens each: windows of one
length wait until they fill one; at the end of a partition those that are left, longest first, fill groups together, which
leaves one group short, and that shares its windows evenly with the group before it.

Each partition is packed on its own while it streams, so there is no shuffle, memory is bounded by `pool_tokens` and one
step group of each length, and a lost task is repeated alone. A null text is an empty one (just the closing id), a very long
one is cut into windows; remainders of equal length are taken in the order they came; null and repeated doc_ids are packed
row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphspark.llm.common import bounded_batches

TIERS = (128, 256, 512, 1024)
#: Tokens of remainders held by one task before they are packed.
POOL_TOKENS = 4_000_000
#: Tokens that one step group aims at.
STEP_TOKENS = 32_768
CLOSING_ID = 0
#: tiktoken gives up on about a million white-space characters in a row; from half of that on, tokenizers takes the text.
BLANK_RUN = 500_000
_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian uint32 bytes.

    Where the merges of the tokenizer file come in the order of their ids, texts go through tiktoken with the file's own
    vocabulary, which gives the same ids several times faster; otherwise through tokenizers.
    """

    _by_path: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = _ranked(path)

    def ids(self, text: str) -> list[int]:
        if self.ranked is None or (len(text) >= BLANK_RUN and _BLANKS.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked(text)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encode(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()


def _ranked(path: str) -> Callable[[str], list[int]] | None:
    """tiktoken's encoder for a byte-level BPE file whose merged ids ascend with the merges, else None."""
    import tiktoken
    from public_tokenizers import PATTERN

    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*printable}))}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if all(c in letters for c in token) and n <= merged[-1]}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Packer:
    """Packs remainders of one partition. A piece is (length, serial, doc_id, start, ids, doc_tokens)."""

    def __init__(self, tiers: tuple[int, ...], partition: int):
        self.tiers, self.base = tiers, partition << 32
        self.pool: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held = self.serial = self.sequences = self.groups = 0
        self.ready: list[tuple[int, list[tuple]]] = []
        self.waiting: dict[int, list[list[tuple]]] = defaultdict(list)
        self.last: list[tuple[int, list[tuple]]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[-1]
        at = 0
        while total - at >= top:
            self.ready.append((top, [(top, 0, doc_id, at, ids[4 * at : 4 * (at + top)], total)]))
            at += top
        if at < total:
            self._route((total - at, self.serial, doc_id, at, ids[4 * at :], total))
            self.held += total - at
            self.serial += 1

    def _route(self, piece: tuple) -> None:
        insort(self.pool[next(t for t in self.tiers if piece[0] <= t)], piece)

    def _fitting(self, gap: int, below: int) -> tuple | None:
        """The longest whole piece of the tiers up to `below` that fits in the gap."""
        for t in reversed(self.tiers):
            if t <= below and (own := self.pool[t]):
                k = bisect_right(own, (gap, float("inf")))
                if k:
                    return own.pop(k - 1)
        return None

    def _cut(self, gap: int, tier: int) -> tuple | None:
        """The first `gap` tokens of the shortest piece left; the rest goes back to its tier."""
        for t in self.tiers:
            if t <= tier and (own := self.pool[t]):
                n, serial, doc_id, start, ids, total = own.pop(0)
                self._route((n - gap, serial, doc_id, start + gap, ids[4 * gap :], total))
                return (gap, serial, doc_id, start, ids[: 4 * gap], total)
        return None

    def pack(self, last: bool) -> None:
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, shorter = self.tiers[k], self.tiers[k - 1] if k else 0
            own = self.pool[tier]
            while own:
                window, gap = [own.pop()], tier
                gap -= window[0][0]
                while gap:
                    piece = self._fitting(gap, shorter if shorter else tier) or self._cut(gap, tier)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[0]
                if not gap:
                    self.ready.append((tier, window))
                elif last:
                    self._in_powers(window)
                else:  # the pool is empty but for this window
                    for n, _, *rest in window:
                        self._route((n, self.serial, *rest))
                        self.serial += 1
                    self.held = sum(p[0] for p in window)
                    return
        self.held = 0

    def _in_powers(self, window: list[tuple]) -> None:
        left = sum(p[0] for p in window)
        pieces = window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            part, gap = [], size
            while gap:
                n, serial, doc_id, start, ids, total = pieces.pop()
                if n > gap:
                    pieces.append((n - gap, serial, doc_id, start + gap, ids[4 * gap :], total))
                    n, ids = gap, ids[: 4 * gap]
                part.append((n, serial, doc_id, start, ids, total))
                gap -= n
            self.ready.append((size, part))
            left -= size

    def _grouped(self, step_tokens: int, last: bool) -> list[list[tuple[int, list[tuple]]]]:
        """Step groups that are complete, the latest one held back until the end. A length beyond step_tokens is a group alone."""
        for size, window in self.ready:
            self.waiting[size].append(window)
        self.ready = []
        full = []
        for size, windows in sorted(self.waiting.items(), reverse=True):
            n = max(1, step_tokens // size)
            whole = len(windows) // n * n
            full += [[(size, w) for w in windows[a : a + n]] for a in range(0, whole, n)]
            del windows[:whole]
        if last:
            rest = [(size, w) for size, windows in sorted(self.waiting.items(), reverse=True) for w in windows]
            self.waiting.clear()
            now, held = [], 0
            for item in rest:  # powers of two, longest first: a group is filled to the last token before the next one opens
                if now and held + item[0] > step_tokens:
                    full.append(now)
                    now, held = [], 0
                now.append(item)
                held += item[0]
            if now:
                full.append(now)
        if self.last:
            full.insert(0, self.last)
            self.last = []
        if not last:
            if full:
                self.last = full.pop()
        elif len(full) > 1 and 2 * sum(s for s, _ in full[-1]) < step_tokens:
            full[-2:] = _halves(full[-2] + full[-1])
        return full

    def rows(self, step_tokens: int, last: bool = False) -> pa.RecordBatch:
        """The windows of the step groups that are complete."""
        out: list[tuple] = []
        for group in self._grouped(step_tokens, last):
            for size, window in group:
                at = 0
                for n, _, doc_id, start, ids, total in window:
                    out.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.sequences, at, size, self.base + self.groups))
                    at += n
                self.sequences += 1
            self.groups += 1
        columns = list(zip(*out, strict=True)) or [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=ARROW)


def _halves(windows: list[tuple[int, list[tuple]]]) -> list[list[tuple[int, list[tuple]]]]:
    """Two groups of about equally many tokens: longest first, each to the lighter one."""
    out, held = ([], []), [0, 0]
    for item in sorted(windows, key=lambda w: -w[0]):
        k = int(held[1] < held[0])
        out[k].append(item)
        held[k] += item[0]
    return [g for g in out if g]


def packing(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents of (doc_id, text) in full sequences of the tier lengths; see the module's text."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, packer = Encoder.of(path), Packer(tiers, context.partitionId() if context else 0)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, encoder.encode(text or "") + closing)
                if packer.held > pool_tokens:
                    packer.pack(last=False)
            yield packer.rows(step_tokens)
        packer.pack(last=True)
        yield packer.rows(step_tokens, last=True)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
