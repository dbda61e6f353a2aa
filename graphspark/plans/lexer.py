"""Tokens of the query language."""

from __future__ import annotations

import re
from typing import NamedTuple

from graphspark.errors import ParseError

#: Reserved words.
KEYWORDS = frozenset("MATCH WHERE RETURN CREATE DELETE SET ORDER BY ASC DESC LIMIT SKIP AND OR NOT AS DISTINCT IN IS NULL TRUE FALSE STARTS ENDS WITH CONTAINS CALL YIELD".split())

_RULES = [
    ("space", r"\s+|//[^\n]*"),
    ("float", r"\d+\.\d+"),
    ("int", r"\d+"),
    ("word", r"[A-Za-z_][A-Za-z0-9_]*"),
    ("quoted", r"`[^`]*`"),
    ("string", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"),
    ("op", r"<=|>=|<>|\.\.|[-+*/%=<>()\[\]{}:,.|$]"),
]
_TOKEN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _RULES), re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}


class Token(NamedTuple):
    kind: str  # keyword, name, int, float, string, op, end
    value: object
    at: int
    end: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(at, f"unexpected character {text[at]!r}")
        kind, raw = m.lastgroup, m.group()
        if kind == "word":
            out.append(Token("keyword", raw.upper(), at, m.end()) if raw.upper() in KEYWORDS else Token("name", raw, at, m.end()))
        elif kind == "quoted":
            out.append(Token("name", raw[1:-1], at, m.end()))
        elif kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), raw[1:-1], flags=re.S), at, m.end()))
        elif kind in ("int", "float"):
            out.append(Token(kind, int(raw) if kind == "int" else float(raw), at, m.end()))
        elif kind == "op":
            out.append(Token("op", raw, at, m.end()))
        at = m.end()
    return [*out, Token("end", None, len(text), len(text))]
