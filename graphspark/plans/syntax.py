"""Syntax tree and parser of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from graphspark.errors import ParseError
from graphspark.plans.lexer import Token, tokens


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # -, NOT, IS NULL, IS NOT NULL
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    types: tuple[str, ...]
    props: tuple[tuple[str, Any], ...]
    direction: str  # out, in, both
    hops: tuple[int, int] | None = None


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Item:
    expr: Any
    name: str


@dataclass
class Query:
    paths: list[Path] = field(default_factory=list)
    where: Any = None
    items: list[Item] | None = None
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    create: list[Path] = field(default_factory=list)
    delete: list[str] = field(default_factory=list)
    sets: list[tuple[Prop, Any]] = field(default_factory=list)
    call: tuple[str, tuple] | None = None


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokens(text), 0

    # --- token access
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def is_op(self, *values: str) -> bool:
        return self.now.kind == "op" and self.now.value in values

    def is_word(self, *values: str) -> bool:
        return self.now.kind == "keyword" and self.now.value in values

    def take(self, *values: str) -> bool:
        if self.is_op(*values) or self.is_word(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value}")

    def fail(self, message: str):
        shown = self.text[self.now.at : self.now.end] or "the end"
        raise ParseError(self.now.at, f"{message}, found {shown}")

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("expected a name")
        self.i += 1
        return self.tokens[self.i - 1].value

    def label(self) -> str:
        """After a colon reserved words are names too."""
        if self.now.kind == "keyword":
            self.i += 1
            t = self.tokens[self.i - 1]
            return self.text[t.at : t.end]
        return self.name()

    def number(self) -> int:
        if self.now.kind != "int":
            self.fail("expected a whole number")
        self.i += 1
        return self.tokens[self.i - 1].value

    # --- statements
    def statement(self) -> Query:
        q = Query()
        if self.take("CALL"):
            name = self.name()
            while self.take("."):
                name += "." + self.name()
            self.need("(")
            q.call = (name.lower(), self.listed(")"))
            return self.ended(q)
        while self.take("MATCH"):
            q.paths.append(self.path())
            while self.take(","):
                q.paths.append(self.path())
            if self.take("WHERE"):
                e = self.expr()
                q.where = e if q.where is None else Binary("AND", q.where, e)
        if self.take("CREATE"):
            q.create.append(self.path())
            while self.take(","):
                q.create.append(self.path())
        if self.take("SET"):
            while True:
                target = self.postfix()
                if not isinstance(target, Prop):
                    self.fail("expected a property")
                self.need("=")
                q.sets.append((target, self.expr()))
                if not self.take(","):
                    break
        if self.take("DELETE"):
            q.delete.append(self.name())
            while self.take(","):
                q.delete.append(self.name())
        self.tail(q)
        if not (q.paths or q.create):
            self.fail("expected MATCH, CREATE or CALL")
        if q.paths and not (q.items or q.create or q.delete or q.sets):
            self.fail("expected RETURN")
        return self.ended(q)

    def ended(self, q: Query) -> Query:
        if self.now.kind != "end":
            self.fail("expected the end")
        return q

    def tail(self, q: Query) -> None:
        """RETURN, ORDER BY, SKIP and LIMIT; the order clauses may also stand before RETURN."""
        while True:
            if self.take("ORDER"):
                self.need("BY")
                while True:
                    e = self.expr()
                    down = self.take("DESC")
                    if not down:
                        self.take("ASC")
                    q.order.append((e, down))
                    if not self.take(","):
                        break
            elif self.take("SKIP"):
                q.skip = self.number()
            elif self.take("LIMIT"):
                q.limit = self.number()
            elif q.items is None and self.take("RETURN"):
                q.distinct = self.take("DISTINCT")
                q.items = [self.item()]
                while self.take(","):
                    q.items.append(self.item())
            else:
                return

    def item(self) -> Item:
        start = self.now.at
        e = self.expr()
        text = self.text[start : self.tokens[self.i - 1].end]
        return Item(e, self.name() if self.take("AS") else text)

    # --- patterns
    def path(self) -> Path:
        nodes, edges = [self.node()], []
        while self.is_op("-", "<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(tuple(nodes), tuple(edges))

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.now.kind == "name" else None
        labels = []
        while self.take(":"):
            labels.append(self.label())
        props = self.props()
        self.need(")")
        return NodePattern(var, tuple(labels), props)

    def props(self) -> tuple:
        out = []
        if self.take("{"):
            while not self.is_op("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.constant()))
                if not self.take(","):
                    break
            self.need("}")
        return tuple(out)

    def constant(self) -> Any:
        minus = self.take("-")
        t = self.now
        self.i += 1
        if t.kind in ("int", "float"):
            return -t.value if minus else t.value
        if not minus:
            if t.kind == "string":
                return t.value
            if t.kind == "keyword" and t.value in ("TRUE", "FALSE", "NULL"):
                return {"TRUE": True, "FALSE": False, "NULL": None}[t.value]
        self.i -= 1
        self.fail("expected a literal")

    def edge(self) -> EdgePattern:
        back = self.take("<")
        self.need("-")
        var, types, props, hops = None, [], (), None
        if self.take("["):
            var = self.name() if self.now.kind == "name" else None
            while self.take(":", "|"):
                self.take(":")
                types.append(self.label())
            if self.take("*"):
                low = self.number() if self.now.kind == "int" else 1
                if self.take(".."):
                    if self.now.kind != "int":
                        self.fail("a path of variable length needs an upper bound")
                    hops = (low, self.number())
                else:
                    hops = (low, low)
            props = self.props()
            self.need("]")
        self.need("-")
        ahead = self.take(">")
        if back and ahead:
            self.fail("an edge can't point both ways")
        return EdgePattern(var, tuple(dict.fromkeys(types)), props, "in" if back else "out" if ahead else "both", hops)

    # --- expressions, loosest first
    def expr(self) -> Any:
        e = self.conjunction()
        while self.take("OR"):
            e = Binary("OR", e, self.conjunction())
        return e

    def conjunction(self) -> Any:
        e = self.negation()
        while self.take("AND"):
            e = Binary("AND", e, self.negation())
        return e

    def negation(self) -> Any:
        return Unary("NOT", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Any:
        e = self.sum()
        while True:
            if self.is_op("=", "<>", "<", "<=", ">", ">="):
                self.i += 1
                e = Binary(self.tokens[self.i - 1].value, e, self.sum())
            elif self.take("IS"):
                none = not self.take("NOT")
                self.need("NULL")
                e = Unary("IS NULL" if none else "IS NOT NULL", e)
            elif self.take("STARTS"):
                self.need("WITH")
                e = Binary("STARTS WITH", e, self.sum())
            elif self.take("ENDS"):
                self.need("WITH")
                e = Binary("ENDS WITH", e, self.sum())
            elif self.take("CONTAINS"):
                e = Binary("CONTAINS", e, self.sum())
            elif self.take("IN"):
                self.need("[")
                e = Binary("IN", e, ListOf(self.listed("]")))
            else:
                return e

    def sum(self) -> Any:
        e = self.product()
        while self.is_op("+", "-"):
            self.i += 1
            e = Binary(self.tokens[self.i - 1].value, e, self.product())
        return e

    def product(self) -> Any:
        e = self.sign()
        while self.is_op("*", "/", "%"):
            self.i += 1
            e = Binary(self.tokens[self.i - 1].value, e, self.sign())
        return e

    def sign(self) -> Any:
        return Unary("-", self.sign()) if self.take("-") else self.postfix()

    def postfix(self) -> Any:
        e = self.primary()
        while self.take("."):
            e = Prop(e, self.name())
        return e

    def primary(self) -> Any:
        t = self.now
        if t.kind in ("int", "float", "string"):
            self.i += 1
            return Literal(t.value)
        if t.kind == "keyword" and t.value in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return Literal({"TRUE": True, "FALSE": False, "NULL": None}[t.value])
        if self.take("["):
            return ListOf(self.listed("]"))
        if self.is_op("("):
            return self.pattern_or_group()
        name = self.name()
        if self.take("("):
            if self.take("*"):
                self.need(")")
                return Call(name.lower(), (), star=True)
            distinct = self.take("DISTINCT")
            return Call(name.lower(), self.listed(")"), distinct=distinct)
        return Var(name)

    def pattern_or_group(self) -> Any:
        """A parenthesis opens a path if one can be read that has an edge, else a group."""
        start = self.i
        try:
            path = self.path()
            if path.edges:
                return Exists(path)
        except ParseError:
            pass
        self.i = start + 1
        e = self.expr()
        self.need(")")
        return e

    def listed(self, close: str) -> tuple:
        out = []
        if not self.take(close):
            out.append(self.expr())
            while self.take(","):
                out.append(self.expr())
            self.need(close)
        return tuple(out)


def parse(text: str) -> Query:
    return Parser(text).statement()
