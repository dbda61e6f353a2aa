"""Personal data with offset-preserving deobfuscation (operator 7).

Base spans come from four patterns over the text as it is. Where a text shows signs of disguise, transducers rewrite it
step by step (homoglyphs and invisible characters, spelled-out digits, at/dot disguises); every character of the
rewritten text keeps the source range it came from. The same patterns run over the rewritten text, and a hit that holds
a rewritten character becomes an added span over its source range. Base spans always stay.

Offsets are code points, ends exclusive. A null text is an empty one: no spans, and the hash of the empty string. A very
long text is read whole. Spans that start together come in the order of KINDS. Null or repeated doc_ids are handled row by
row, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from graphspark.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def scan(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


# --- transducers -------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones, and invisible characters.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaopviktABEZHIKMNOPTYX", strict=True)) | {"\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Spelled digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[\u00a0\u00ad\u0370-\U0010ffff]")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"\b(?=[zotfsen])(?:plus[ -]+)?{_WORD}(?:(?:[ ,-]+|[ ]*(?:dot|point|\.)[ ]*)(?:{_WORD}|[0-9])\b){{3,}}", re.I)
_SPELLED_PLUS = re.compile(rf"\bplus[ -]+(?={_WORD}\b|[0-9])", re.I)
_TOKEN = re.compile(r"plus|dot|point|[a-z]+|[0-9]|[ ,-]+|\.", re.I)
#: White space within a disguise: blanks and one line end at most.
_GAP = r"[ \t]*+(?:\r?\n[ \t]*+)?"
_AT = re.compile(rf"(?<![ \t]){_GAP}[\[({{<]{_GAP}(?:at|@){_GAP}[\])}}>]{_GAP}", re.I)
_DOT = re.compile(rf"(?<![ \t]){_GAP}[\[({{<]{_GAP}(?:dot|\.){_GAP}[\])}}>]{_GAP}", re.I)
_SAID = re.compile(r"(?<![A-Za-z0-9._%+-])[a-z0-9_%+-]++(?:(?:\.| dot )[a-z0-9_%+-]++)*+(?P<at>@| at )[a-z0-9-]++(?:(?:\.| dot )[a-z0-9-]++)++", re.I)
_SAID_PART = re.compile(r"@|\.| at | dot ", re.I)
_BARE = re.compile(r" at [a-z0-9-]++(?:\.[a-z0-9-]++)*(?:\.| dot )[a-z0-9-]")
#: Top-level labels, and words before a bare "at y.z" that are no mailbox.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro app dev io ai co me tv cc xyz online site cloud tech eu uk us ca au nz ie de at ch fr be nl lu it es pt gr pl cz sk hu ro bg hr si rs se no dk fi is ee lv lt ru ua by tr il in pk cn jp kr tw hk sg my th vn id ph br ar cl mx pe za ng ke eg ma ae sa ir".split())
NOT_MAILBOX = frozenset("a all also and are arrive as available be blog book buy check code contact docs download email exist find found from go good here hosted i in is it join learn live located look mail me meet more now of official on one online only or order out page posted published read register resides running see shop sign site sold start stay stop that the them there these this those today up us visit was website we web were work you".split())
_BRACKETED = re.compile(rf"[\[({{<]{_GAP}(?:at|dot|@|\.){_GAP}[\])}}>]", re.I)
#: Spelled parts with a line end beside them: they are read as if it were a blank.
_BROKEN = re.compile(r"(?<=[a-z0-9])(?:[ \t]*\r?\n[ \t]*(?:at|dot)[ \t]+|[ \t]+(?:at|dot)[ \t]*\r?\n[ \t]*)(?=[a-z0-9])", re.I)


class Mapped:
    """A text whose characters know the source range they came from, and whether they were rewritten."""

    def __init__(self, text: str, starts: list[int], ends: list[int], touched: list[bool]):
        self.text, self.starts, self.ends, self.touched = text, starts, ends, touched

    @classmethod
    def of(cls, text: str) -> "Mapped":
        n = len(text)
        return cls(text, list(range(n)), list(range(1, n + 1)), [False] * n)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """With `edits` (start, end, new text), which come in order and apart."""
        if not edits:
            return self
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        touched: list[bool] = []
        at = 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            touched += self.touched[at:a] + [True] * len(new)
            if not new and touched:
                touched[-1] = True
            at = b
        parts.append(self.text[at:])
        return Mapped("".join(parts), starts + self.starts[at:], ends + self.ends[at:], touched + self.touched[at:])


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


def homoglyphs(m: Mapped) -> Mapped:
    return m.rewritten([(k.start(), k.end(), new) for k in _ODD.finditer(m.text) if (new := _plain(k.group())) != k.group()])


def spelled_digits(m: Mapped) -> Mapped:
    """Runs of four or more spelled digits become digits; what parts them goes, but for points."""
    edits = []
    for run in _SPELLED.finditer(m.text):
        plus = [p for p in _SPELLED_PLUS.finditer(m.text, max(0, run.start() - 8), run.end()) if p.end() >= run.start()]
        start = plus[0].start() if plus and plus[0].start() < run.start() else run.start()
        new = []
        for t in _TOKEN.findall(m.text[start : run.end()].lower()):
            new.append("+" if t == "plus" else "." if t in ("dot", "point", ".") else DIGIT_WORDS.get(t, t if t.isdigit() else ""))
        edits.append((start, run.end(), "".join(new)))
    return m.rewritten(edits)


def at_and_dot(m: Mapped) -> Mapped:
    edits = [(k.start(), k.end(), "@") for k in _AT.finditer(m.text)] + [(k.start(), k.end(), ".") for k in _DOT.finditer(m.text)]
    m = m.rewritten(sorted(edits))
    if "\n" in m.text:
        m = m.rewritten([(k.start(), k.end(), f" {k.group().strip()} ") for k in _BROKEN.finditer(m.text)])
    return m.rewritten([e for s in _SAID.finditer(m.text) for e in _said(m, s)])


def _said(m: Mapped, s: re.Match) -> list[tuple[int, int, str]]:
    """Edits of the spelled parts of an address, up to its last label that can be one."""
    parts = [(s.start() + k.start(), s.start() + k.end(), k.group().lower()) for k in _SAID_PART.finditer(s.group())]
    at = next(k for k, p in enumerate(parts) if p[0] == s.start("at"))
    domain = parts[at + 1 :]
    spoken = [p for p in parts if p[2] in (" at ", " dot ")]
    bracketed = any(m.touched[a] for a, _, c in parts if c in "@.")
    ends = [a for a, _, _ in domain[1:]] + [s.end()]
    if parts[at][2] == " at " and all(c == " dot " for _, _, c in domain) or bracketed:
        upto = s.end()
    else:  # mixed with plain signs: a sentence may go on, so a known label must end it
        upto = max((e for (_, b, _), e in zip(domain, ends, strict=True) if m.text[b:e].lower() in TOP_LEVEL), default=0)
    edits = [(a, b, "@" if c == " at " else ".") for a, b, c in spoken if a < upto]
    if len(edits) == 1 and edits[0][2] == "@" and not bracketed and m.text[s.start() : edits[0][0]].lower() in NOT_MAILBOX:
        return []
    return edits


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that only show after rewriting, none of which lies within a base span of its kind."""
    odd = not text.isascii() and _ODD.search(text) is not None
    low = text.lower()
    spelled = _SPELLED.search(low) is not None
    said = " dot " in low or " at " in low and _BARE.search(low) is not None or ("\n" in low and _BROKEN.search(low) is not None) or (("at" in low or "dot" in low or "@" in low) and _BRACKETED.search(text) is not None)
    if not (odd or spelled or said):
        return []
    m = at_and_dot(spelled_digits(homoglyphs(Mapped.of(text))))
    if m.text == text:
        return []
    out = []
    for kind, a, b in scan(m.text):
        if any(m.touched[a:b]):
            start, end = m.starts[a], max(m.ends[a:b])
            if not any(k == kind and s <= start and end <= e for k, s, e in base):
                out.append((kind, start, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    base = scan(text)
    return base, in_order(base + added(text, base))


def redact(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by its kind in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in find(text)[1]:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def personal_data(docs: DataFrame) -> DataFrame:
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


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced in `text`; null texts stay null, n_chars follows the text if there."""
    names = docs.columns
    text_at = names.index("text")
    from pyspark.sql import functions as F

    from graphspark.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            new = pa.array([None if t is None else redact(t) for t in batch.column(text_at).to_pylist()], type=pa.string())
            yield batch.set_column(text_at, pa.field("text", pa.string()), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
