"""Secrets with a recursive decoding worklist (operator 8).

Base spans come from three patterns over the text as it is. Then a worklist starts with the text: each layer is looked
through for URL escapes, Unicode escapes and base64 runs; the bytes of both URL escapes and base64 may be compressed, base64
may hold UTF-16, bytes that are no text between others that are, and may follow other characters of its alphabet, such as a
path. Every decoded layer keeps, for each of its characters, the source range it came from, is scanned with the same
patterns and goes on the worklist itself, until no new layer appears. A layer whose text was already seen on its way from the source is a cycle and is
not followed. Compressed data is inflated to its end, all members of it, in overlapping layers of bounded size. Hits that hold a decoded character become added spans over their source range; base spans always stay.

Offsets are code points, ends exclusive. A null text is an empty one: no spans, and the hash of the empty string. A very
long text is read whole. Spans that start together come in the order of KINDS. Null or repeated doc_ids are handled row by
row, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from graphspark.llm.common import map_rows

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A layer that holds more of these than of all else is not a text.
_CONTROL = [chr(c) for c in (*range(32), *range(127, 160)) if chr(c) not in "\t\n\f\r"] + ["\ufffd"]
_KEYWORDS = ("passw", "secret", "token", "key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: Escapes of bytes as compressed data begins with, and what may follow in a URL.
_URL_RUN = re.compile(r"(?:%1[Ff]%8[Bb]|x%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|%78%(?:01|5[Ee]|9[Cc]|[Dd][Aa]))[A-Za-z0-9%._~!$'()*+,;:@/-]*")
_NUMBER = re.compile(r"[0-9A-Fa-f]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one base64 text: single line breaks, indentation after them.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"[\r\n \t]+")
#: Bytes that are inflated at once, characters of one layer of what compressed data holds, and of the next one's overlap.
PIECE, PART, OVERLAP = 1 << 16, 1 << 20, 1 << 17
#: Text between bytes that are none: the shortest secret and what says it is one are longer.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}"), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){12,}"))
#: How compressed data begins in base64, after a character that may end what came before it.
_PACKED = re.compile(r"(?<=[/_+-])(?:H4sI|eJ|eA|eN|eF)")


def scan(text: str) -> list[Span]:
    """The base spans, by start and then kind. The span of an assignment is the whole match."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


class Layer:
    """Decoded text; character i came from source characters starts[i]:ends[i]. `seen`: hashes of the layers above."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range, touched: list[bool] | None, seen: frozenset[bytes]):
        self.text, self.starts, self.ends, self.touched = text, starts, ends, touched
        self.key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()
        self.cycle = self.key in seen
        self.seen = seen | {self.key}


def _escapes(layer: Layer, pattern: re.Pattern, decoded: callable) -> Layer | None:
    """The whole layer with the escapes decoded; None where nothing changes."""
    parts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    touched: list[bool] = []
    at, found = 0, False
    was = layer.touched or [False] * len(layer.text)
    for m in pattern.finditer(layer.text):
        chars = decoded(m.group())
        if chars is None:
            continue
        found = True
        a = m.start()
        parts.append(layer.text[at:a])
        starts += layer.starts[at:a]
        ends += layer.ends[at:a]
        touched += was[at:a]
        for c, i, j in chars:
            parts.append(c)
            starts.append(layer.starts[a + i])
            ends.append(layer.ends[a + j - 1])
            touched.append(True)
        at = m.end()
    if not found:
        return None
    parts.append(layer.text[at:])
    starts += layer.starts[at:]
    ends += layer.ends[at:]
    touched += was[at:]
    return Layer("".join(parts), starts, ends, touched, layer.seen)


def _url(run: str) -> list[tuple[str, int, int]] | None:
    """Characters of a run of %XX with their ranges in it, if the bytes are UTF-8."""
    try:
        text = bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = 3 * len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out


def _unicode(escape: str) -> list[tuple[str, int, int]] | None:
    code = int(escape[2:-1]) if escape[:2] == "&#" and escape[2] != "x" else int(_NUMBER.search(escape, 2 if escape[0] == "\\" else 3).group(), 16)
    return [(chr(code), 0, len(escape))] if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if _legible(text) else None


def _legible(text: str) -> bool:
    """Not mostly control characters or bytes that aren't UTF-8."""
    return 2 * sum(text.count(c) for c in _CONTROL) <= len(text)


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0)


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What all members hold, in pieces; data that breaks off ends early, broken data raises."""
    inflate, rest = zlib.decompressobj(zlib.MAX_WBITS | 32), b""
    for rest in pieces:
        while rest:
            if inflate.eof:
                rest = rest.lstrip(b"\0")  # padding between members
                if rest and not b"\x1f\x8b".startswith(rest[:2]) and not _compressed(rest):
                    return
                if not rest:
                    break
                inflate = zlib.decompressobj(zlib.MAX_WBITS | 32)
            if out := inflate.decompress(rest, PIECE):
                yield out
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    while not inflate.eof and (out := inflate.decompress(inflate.unconsumed_tail, PIECE)):
        yield out


def _stage(data: bytes, depth: int) -> Iterator[bytes]:
    """`data` unpacked `depth` times."""
    pieces = iter((data,))
    for _ in range(depth):
        pieces = _inflated(pieces)
    return pieces


def _look(pieces: Iterator[bytes]) -> tuple[bytes, bytes] | None:
    """First bytes and hash of a stage; None if nothing of it can be unpacked."""
    head, mark = b"", hashlib.blake2b(digest_size=12)
    try:
        for p in pieces:
            head = head if len(head) > 2 else head + p[:3]
            mark.update(p)
    except zlib.error:
        if not head:
            return None
    return head, mark.digest()


def _depth(data: bytes) -> int:
    """How often `data` can be unpacked until it isn't compressed or was there before: it may unpack to itself."""
    passed, depth, head = {hashlib.blake2b(data, digest_size=12).digest()}, 0, data
    while _compressed(head) and (seen := _look(_stage(data, depth + 1))) is not None:
        depth, (head, mark) = depth + 1, seen
        if mark in passed:
            break
        passed.add(mark)
    return depth


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """The readable parts of a stage, each with the end of the one before; bytes that aren't UTF-8 end a part."""
    decoder, held, new = codecs.getincrementaldecoder("utf-8")(), "", 0
    try:
        for p in pieces:
            try:
                text = decoder.decode(p)
            except UnicodeDecodeError:
                decoder.reset()
                text = p.decode(errors="replace")
            held, new = held + text, new + len(text)
            if len(held) >= PART:
                yield held
                held, new = held[-OVERLAP:], 0
    except zlib.error:
        pass
    if new:
        yield held


def _base64(layer: Layer) -> Iterator[Layer]:
    """A layer for each base64 run, of one line or of several, that holds readable text, and layers for compressed text."""
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            run = m.group()
            if pattern is _BASE64:
                runs = [(run, range(m.start(), m.end()))]
            else:
                runs = _wrapped(run, m.start())
            for body, places in runs:
                yield from _unpacked(layer, body.rstrip("="), places)


def _wrapped(run: str, start: int) -> list[tuple[str, list[int]]]:
    """Lines of one width and a last one that may be shorter, joined, with the place of each character."""
    lines, at = [], 0
    for m in [*_BREAK.finditer(run), None]:
        end = m.start() if m else len(run)
        lines.append((run[at:end], start + at))
        at = m.end() if m else end
    out = []
    first = 0
    while first < len(lines) - 1:
        last = first
        while last + 1 < len(lines) and len(lines[last][0]) == len(lines[first][0]):
            last += 1
            if len(lines[last][0]) > len(lines[first][0]):
                last -= 1
                break
        # what is shorter may also be a word that comes after
        for end in {last, last - (len(lines[last][0]) < len(lines[first][0]))}:
            if end > first:
                out.append(("".join(t for t, _ in lines[first : end + 1]), [p + k for t, p in lines[first : end + 1] for k in range(len(t))]))
        first = max(last, first + 1)
    return out


def _bytes(body: str) -> bytes | None:
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _inflated_layers(layer: Layer, data: bytes, start: int, end: int) -> Iterator[Layer]:
    """Layers of compressed data; each of their characters came from all of it."""
    if depth := _depth(data):
        for text in _texts(_stage(data, depth)):
            if _legible(text):
                yield Layer(text, [start] * len(text), [end] * len(text), [True] * len(text), layer.seen)


def _unpacked(layer: Layer, body: str, places: range | list[int]) -> Iterator[Layer]:
    if (data := _bytes(body)) is None:
        return
    whole = len(body) % 4 != 1

    def span(at: int, n: int, shift: int) -> tuple[int, int]:
        """Source range of n bytes from `at` on, decoded from body[shift:]."""
        last = at + n - 1
        return layer.starts[places[shift + 4 * (at // 3) + at % 3]], layer.ends[places[min(len(body), shift + 4 * (last // 3) + last % 3 + 2) - 1]]

    if whole and _compressed(data):
        found = False
        for x in _inflated_layers(layer, data, layer.starts[places[0]], max(layer.ends[p] for p in places)):
            found = True
            yield x
        if found:
            return
    elif whole and (text := _readable(data)) is not None:
        starts, ends, at = [], [], 0
        for c in text:
            a, b = span(at, n := len(c.encode()), 0)
            starts.append(a)
            ends.append(b)
            at += n
        yield Layer(text, starts, ends, [True] * len(text), layer.seen)
        if "\0" not in text:
            return
    # other characters may come first, so that the groups of four begin elsewhere, and not all bytes need be text
    for shift in range(4):
        part = data if shift == 0 else _bytes(body[shift:])
        if part is None:
            continue
        for pattern, step in ((_STRETCH, 1), *((w, 2) for w in _WIDE)):
            if step == 2 and b"\0" not in part:
                break
            for m in pattern.finditer(part):
                raw = m.group()
                text = raw.replace(b"\0", b"").decode("ascii") if step == 2 else raw.decode("ascii")
                ranges = [span(m.start() + step * i, step, shift) for i in range(len(text))]
                yield Layer(text, [r[0] for r in ranges], [r[1] for r in ranges], [True] * len(text), layer.seen)
    for m in _PACKED.finditer(body):
        if (part := _bytes(body[m.start() :])) is not None and _compressed(part):
            yield from _inflated_layers(layer, part, layer.starts[places[m.start()]], max(layer.ends[p] for p in places[m.start() :]))


def _packed_escapes(layer: Layer) -> Iterator[Layer]:
    """Layers of compressed data in URL escapes; characters between them stand for themselves, up to what no URL holds."""
    for m in _URL_RUN.finditer(layer.text):
        run = m.group()
        if "%" in run and _compressed(data := unquote_to_bytes(run)):
            yield from _inflated_layers(layer, data, layer.starts[m.start()], layer.ends[m.end() - 1])


def decoded(layer: Layer) -> Iterator[Layer]:
    """What one step of decoding makes of a layer."""
    if "%" in layer.text and (x := _escapes(layer, _URL, _url)) and not x.cycle:
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _escapes(layer, _UNICODE, _unicode)) and not x.cycle:
        yield x
    if "%" in layer.text:
        yield from (x for x in _packed_escapes(layer) if not x.cycle)
    yield from (x for x in _base64(layer) if not x.cycle)


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that show in decoded layers only."""
    work = [decoded(Layer(text, range(len(text)), range(1, len(text) + 1), None, frozenset()))]
    done, out = set(), set()
    while work:  # the way from the source to one layer: layers come one at a time
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        place = (layer.key, layer.starts[0] if layer.text else 0)
        if place in done:
            continue
        done.add(place)
        for kind, a, b in scan(layer.text):
            if any(layer.touched[a:b]):
                start, end = min(layer.starts[a:b]), max(layer.ends[a:b])
                if not any(k == kind and s <= start and end <= e for k, s, e in base):
                    out.add((kind, start, end))
        work.append(decoded(layer))
    return list(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    base = scan(text)
    return base, in_order(base + added(text, base))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of every whole text of (doc_id, text)."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ARROW.names}
        out["doc_id"] = batch["doc_id"]
        for text in batch["text"]:
            base, every = find(text or "")
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
            out["n_added"].append(len(every) - len(base))
        return out

    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), rows, SCHEMA, ARROW)
