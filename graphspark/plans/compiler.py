"""From syntax tree to DataFrame. Patterns become joins over the tables that can match; Catalyst does the rest."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.errors import AnalysisError
from graphspark.functions import scalars as S
from graphspark.functions.scalars import Value
from graphspark.graph import EdgeTable, NodeTable, PropertyGraph, union
from graphspark.plans import syntax as X

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
#: Properties of a node or edge that its own fields come before.
NODE_FIELDS = ("id", "labels", "properties")
EDGE_FIELDS = ("id", "source", "target", "edge_type", "weight", "properties")


@dataclass
class Bound:
    """A bound variable: its columns are `<name>__<field>`; kinds: property -> kind."""

    name: str
    is_edge: bool
    kinds: dict[str, str]


class Compiler:
    def __init__(self, graph: PropertyGraph, compat: bool = False):
        self.graph, self.compat = graph, compat
        self.bound: dict[str, Bound] = {}
        self.needs: dict[str, set[str]] = defaultdict(set)
        self.fresh = 0

    # --- which fields of which variables are used
    def note(self, e) -> None:
        if isinstance(e, X.Prop):
            if isinstance(e.of, X.Var):
                self.needs[e.of.name].add(e.name)
            else:
                self.note(e.of)
        elif isinstance(e, X.Var):
            self.needs[e.name].add("*")
        elif isinstance(e, X.Call):
            if e.name in ("id", "labels", "type") and len(e.args) == 1 and isinstance(e.args[0], X.Var):
                self.needs[e.args[0].name].add({"id": "id", "labels": "labels", "type": "edge_type"}[e.name])
            elif e.name == "count" and len(e.args) == 1 and isinstance(e.args[0], X.Var):
                self.needs[e.args[0].name].add("id")
            else:
                for a in e.args:
                    self.note(a)
        elif isinstance(e, X.Unary):
            self.note(e.arg)
        elif isinstance(e, X.Binary):
            self.note(e.left)
            self.note(e.right)
        elif isinstance(e, X.ListOf):
            for a in e.items:
                self.note(a)

    def anonymous(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # --- scans
    def node_scan(self, p: X.NodePattern, var: str, within: tuple[str, ...] | None = None) -> DataFrame:
        """Nodes that match p as columns of var; `within`: labels that the node is known to have."""
        tables = [t for t in self.graph.node_tables if t.labels is None or set(p.labels) <= set(t.labels) and (within is None or set(within) <= set(t.labels))]
        wanted = self.needs[var] | {k for k, _ in p.props}
        if not tables:
            tables = [replace(self.graph.node_tables[0], df=self.graph.node_tables[0].df.limit(0))]
        if "*" in wanted or "properties" in wanted:
            wanted = wanted | {"*"}
        props = sorted({n for t in tables for n in t.props} & wanted - set(NODE_FIELDS))
        kinds = self._kinds(tables, props)
        frames = []
        for t in tables:
            df = t.df
            if t.labels is None:
                for label in p.labels:
                    df = df.where(F.array_contains("labels", label))
            for k, v in p.props:
                df = df.where(self._same(t, k, v))
            out = [F.col("node_id").alias(f"{var}__id")]
            if wanted & {"labels", "*"}:
                out.append((F.col("labels") if t.labels is None else F.array(*map(F.lit, t.labels))).alias(f"{var}__labels"))
            if "*" in wanted:
                from graphspark.graph import as_json

                out.append(as_json(t.props, t.df).alias(f"{var}__json"))
            out += [self._prop(t, n, kinds[n]).alias(f"{var}__p_{n}") for n in props]
            frames.append(df.select(*out))
        self.bound[var] = Bound(var, False, kinds)
        return union(frames)

    def _kinds(self, tables, props: list[str]) -> dict[str, str]:
        out = {}
        for n in props:
            kinds = {S.kind_of(t.df.schema[t.props[n]].dataType) for t in tables if n in t.props}
            out[n] = kinds.pop() if len(kinds) == 1 else "float" if kinds <= {"int", "float"} else "str"
        return out

    @staticmethod
    def _prop(t: NodeTable | EdgeTable, n: str, kind: str) -> Column:
        c = F.col(f"`{t.props[n]}`") if n in t.props else F.lit(None)
        return c if kind == "list" else c.cast(S.SPARK[kind])

    @staticmethod
    def _same(t: NodeTable | EdgeTable, key: str, value) -> Column:
        """Inline property: the same JSON value, so 30 isn't 30.0; a missing key never matches."""
        if key not in t.props:
            return F.lit(False)
        c, kind = F.col(f"`{t.props[key]}`"), S.kind_of(t.df.schema[t.props[key]].dataType)
        if value is None:
            return c.isNull()
        lit = S.literal(value)
        return c == lit.col if lit.kind == kind else F.lit(False)

    def edge_scan(self, p: X.EdgePattern, var: str, src: tuple[str, ...], dst: tuple[str, ...]) -> tuple[DataFrame, list[EdgeTable]]:
        """Edges that match p with columns __from and __to in the walking direction; src and dst: labels asked of the ends."""
        can = lambda asked, has: has is None or set(asked) <= set(has)
        wanted = self.needs[var] | {k for k, _ in p.props}
        frames, used = [], []
        tables = [t for t in self.graph.edge_tables if t.edge_type is None or not p.types or t.edge_type in p.types]
        props = sorted({n for t in tables for n in t.props} & (wanted | ({n for t in tables for n in t.props} if "*" in wanted else set())) - set(EDGE_FIELDS))
        kinds = self._kinds(tables, props)
        for t in tables:
            ways = []
            if p.direction in ("out", "both") and can(src, t.src_labels) and can(dst, t.dst_labels):
                ways.append(("src", "dst"))
            if p.direction in ("in", "both") and can(src, t.dst_labels) and can(dst, t.src_labels):
                ways.append(("dst", "src"))
            for n, (a, b) in enumerate(ways):
                df = t.df
                if t.edge_type is None and p.types:
                    df = df.where(F.col("edge_type").isin(*p.types))
                for k, v in p.props:
                    df = df.where(self._same(t, k, v))
                if n:
                    df = df.where(F.col("src") != F.col("dst"))  # a self-loop is walked once
                kind = F.col("edge_type") if t.edge_type is None else F.lit(t.edge_type)
                out = [F.col(a).alias("__from"), F.col(b).alias("__to")]
                if "*" in wanted or "id" in wanted:
                    out.append(F.col("edge_id").alias(f"{var}__id"))
                if wanted & {"*", "source"}:
                    out.append(F.col("src").alias(f"{var}__src"))
                if wanted & {"*", "target"}:
                    out.append(F.col("dst").alias(f"{var}__dst"))
                if wanted & {"*", "edge_type"}:
                    out.append(kind.alias(f"{var}__type"))
                if wanted & {"*", "weight"}:
                    out.append(F.col("weight").alias(f"{var}__weight"))
                if "*" in wanted or "properties" in wanted:
                    from graphspark.graph import as_json

                    out.append(as_json(t.props, t.df).alias(f"{var}__json"))
                out += [self._prop(t, n_, kinds[n_]).alias(f"{var}__p_{n_}") for n_ in props]
                frames.append(df.select(*out))
                used.append(t if (a, b) == ("src", "dst") else replace(t, src_labels=t.dst_labels, dst_labels=t.src_labels))
        self.bound[var] = Bound(var, True, kinds)
        if not frames:
            frames = [self.graph.spark.createDataFrame([], "__from long, __to long")]
        return union(frames), used

    # --- patterns
    def path(self, rows: DataFrame | None, p: X.Path) -> DataFrame:
        """Join a path to the rows: from a variable that is already bound if there is one, to both sides."""
        names = [n.var or self.anonymous() for n in p.nodes]
        labels = {}
        for n, v in zip(p.nodes, names, strict=True):
            labels[v] = tuple(dict.fromkeys((*labels.get(v, ()), *n.labels)))
        start = next((i for i, v in enumerate(names) if v in self.bound), 0)
        first = p.nodes[start]
        if names[start] in self.bound:
            if first.labels or first.props:
                again = self.anonymous()
                rows = rows.join(self.node_scan(first, again), F.col(f"{names[start]}__id") == F.col(f"{again}__id"), "left_semi")
                del self.bound[again]
        else:
            scan = self.node_scan(first, names[start])
            rows = scan if rows is None else rows.crossJoin(scan)
        turned = {"out": "in", "in": "out", "both": "both"}
        for i in range(start, len(p.edges)):
            rows = self.hop(rows, names[i], p.edges[i], p.nodes[i + 1], names[i + 1], labels)
        for i in range(start - 1, -1, -1):
            rows = self.hop(rows, names[i + 1], replace(p.edges[i], direction=turned[p.edges[i].direction]), p.nodes[i], names[i], labels)
        return rows

    def hop(self, rows: DataFrame, at: str, e: X.EdgePattern, n: X.NodePattern, to: str, labels: dict) -> DataFrame:
        if e.hops:
            if e.var:
                raise AnalysisError("an edge of variable length can't be named")
            return self.walk(rows, at, e, n, to, labels)
        var = e.var or self.anonymous()
        if var in self.bound:
            raise AnalysisError(f"edge variable {var} is used twice")
        edges, used = self.edge_scan(e, var, labels.get(at, ()), n.labels)
        return self.arrive(rows.join(edges, F.col(f"{at}__id") == F.col("__from")), n, to, used)

    def arrive(self, joined: DataFrame, n: X.NodePattern, to: str, used: list[EdgeTable]) -> DataFrame:
        if to in self.bound:
            out = joined.where(F.col("__to") == F.col(f"{to}__id")).drop("__from", "__to")
            if n.labels or n.props:
                again = self.anonymous()
                out = out.join(self.node_scan(n, again), F.col(f"{to}__id") == F.col(f"{again}__id"), "left_semi")
                del self.bound[again]
            return out
        declared = used and all(t.dst_labels is not None and set(n.labels) <= set(t.dst_labels) for t in used)
        if not n.props and not (self.needs[to] - {"id"}) and (declared or not n.labels):
            self.bound[to] = Bound(to, False, {})
            return joined.withColumnRenamed("__to", f"{to}__id").drop("__from")
        within = used[0].dst_labels if used and all(t.dst_labels == used[0].dst_labels for t in used) else None
        return joined.join(self.node_scan(n, to, within), F.col("__to") == F.col(f"{to}__id")).drop("__from", "__to")

    def walk(self, rows: DataFrame, at: str, e: X.EdgePattern, n: X.NodePattern, to: str, labels: dict) -> DataFrame:
        """Walks of low to high hops: bounded joins, one more for each length."""
        low, high = e.hops
        single = replace(e, hops=None)
        frontier = rows.withColumn("__to", F.col(f"{at}__id"))
        ends = [frontier] if low == 0 else []
        for k in range(1, high + 1):
            var = self.anonymous()
            edges, _ = self.edge_scan(single, var, labels.get(at, ()) if k == 1 else (), ())
            del self.bound[var]
            frontier = frontier.withColumnRenamed("__to", "__here").join(edges.select("__from", "__to"), F.col("__here") == F.col("__from")).drop("__here", "__from")
            if k >= low:
                ends.append(frontier)
        return self.arrive(union(ends), n, to, [])

    # --- expressions
    def field(self, var: str, name: str) -> Value:
        if var not in self.bound:
            raise AnalysisError(f"unknown variable {var}")
        b = self.bound[var]
        own = {"id": ("id", "int"), "source": ("src", "int"), "target": ("dst", "int"), "edge_type": ("type", "str"), "weight": ("weight", "float")} if b.is_edge else {"id": ("id", "int"), "labels": ("labels", "list")}
        if name in own:
            return Value(F.col(f"{var}__{own[name][0]}"), own[name][1])
        if name == "properties":
            return Value(F.col(f"{var}__json"), "json")
        return Value(F.col(f"`{var}__p_{name}`"), b.kinds[name]) if name in b.kinds else S.null()

    def whole(self, var: str) -> Value:
        if var not in self.bound:
            raise AnalysisError(f"unknown variable {var}")
        c = lambda f: F.col(f"{var}__{f}")
        props = F.try_parse_json(c("json"))
        if self.bound[var].is_edge:
            s = F.struct(c("id").alias("id"), c("src").alias("source"), c("dst").alias("target"), c("type").alias("edge_type"), props.alias("properties"), c("weight").alias("weight"))
        else:
            s = F.struct(c("id").alias("id"), c("labels").alias("labels"), props.alias("properties"))
        return Value(F.to_json(s), "json")

    def value(self, e) -> Value:
        if isinstance(e, X.Literal):
            return S.literal(e.value)
        if isinstance(e, X.Var):
            return self.whole(e.name)
        if isinstance(e, X.Prop):
            if isinstance(e.of, X.Var):
                return self.field(e.of.name, e.name)
            inner = self.value(e.of)
            return Value(F.get_json_object(inner.col, f"$.{e.name}"), "str") if inner.kind in ("str", "json") else S.null()
        if isinstance(e, X.Unary):
            if e.op == "-":
                return S.negative(self.value(e.arg))
            if e.op == "NOT":
                if isinstance(e.arg, X.Exists):
                    raise AnalysisError("a pattern can only stand in WHERE, joined by AND")
                return Value(~S.truth(self.value(e.arg)), "bool")
            c = self.value(e.arg).col
            return Value(c.isNull() if e.op == "IS NULL" else c.isNotNull(), "bool")
        if isinstance(e, X.Binary):
            if e.op in ("AND", "OR"):
                a, b = S.truth(self.value(e.left)), S.truth(self.value(e.right))
                return Value(a & b if e.op == "AND" else a | b, "bool")
            if e.op == "IN":
                a = self.value(e.left)
                return Value(reduce(lambda x, y: x | y, (S.equal(a, self.value(i)) for i in e.right.items), F.lit(False)), "bool")
            a, b = self.value(e.left), self.value(e.right)
            if e.op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
                return Value(S.string_test(e.op, a, b), "bool")
            return S.arithmetic(e.op, a, b) if e.op in "+-*/%" else Value(S.compare(e.op, a, b), "bool")
        if isinstance(e, X.Call):
            return self.call(e)
        if isinstance(e, X.ListOf):
            items = [self.value(i) for i in e.items]
            return Value(F.array(*(i.col for i in items)), "list")
        raise AnalysisError(f"not a value: {e}")

    def call(self, e: X.Call) -> Value:
        if e.name in AGGREGATES:
            return self.aggregate(e)
        if e.name in ("id", "labels", "type"):
            if len(e.args) != 1 or not isinstance(e.args[0], X.Var):
                raise AnalysisError(f"{e.name} needs a variable")
            var = e.args[0].name
            if var in self.bound and self.bound[var].is_edge != (e.name == "type") and e.name != "id":
                return S.null()
            return self.field(var, {"id": "id", "labels": "labels", "type": "edge_type"}[e.name])
        args = [self.value(a) for a in e.args]
        one = {"tostring": S.to_string, "tointeger": S.to_integer, "toint": S.to_integer, "tofloat": S.to_float, "toboolean": S.to_boolean}
        if e.name in one:
            if len(args) != 1:
                raise AnalysisError(f"{e.name} needs one argument")
            return one[e.name](args[0])
        if e.name in self.graph.functions:
            out = self.graph.functions[e.name](*(a.col for a in args))
            return Value(out, "str") if isinstance(out, Column) else Value(*out)
        raise AnalysisError(f"unknown function {e.name}")

    def aggregate(self, e: X.Call) -> Value:
        if e.name == "count":
            if e.star or not e.args:
                return Value(F.count(F.lit(1)), "int")
            v = self.field(e.args[0].name, "id") if isinstance(e.args[0], X.Var) else self.value(e.args[0])
            return Value(F.count_distinct(v.col) if e.distinct else F.count(v.col), "int")
        if self.compat and e.name != "collect":
            return S.null()  # recognised, never computed
        (arg,) = e.args or (X.Literal(None),)
        v = self.value(arg)
        if e.name in ("sum", "avg"):
            if v.kind not in S.NUMERIC:
                return Value(F.first(F.lit(None).cast("double")), "float")
            make = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((e.name, e.distinct), F.avg)
            return Value(make(v.col), v.kind if e.name == "sum" else "float")
        if e.name == "collect":
            return Value(F.array_sort(F.collect_set(v.col) if e.distinct else F.collect_list(v.col)), "list")
        return Value(F.min(v.col) if e.name == "min" else F.max(v.col), v.kind)

    # --- clauses
    def where(self, rows: DataFrame, e) -> DataFrame:
        """Filter by a condition; its conjuncts are kept apart so that Catalyst can push each."""
        if isinstance(e, X.Binary) and e.op == "AND":
            return self.where(self.where(rows, e.left), e.right)
        if isinstance(e, X.Exists):
            return self.exists(rows, e.path, "left_semi")
        if isinstance(e, X.Unary) and e.op == "NOT" and isinstance(e.arg, X.Exists):
            return self.exists(rows, e.arg.path, "left_anti")
        return rows.where(self.condition(e))

    def condition(self, e) -> Column:
        if isinstance(e, X.Binary) and e.op in ("AND", "OR"):
            a, b = self.condition_truth(e.left), self.condition_truth(e.right)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, X.Binary) and e.op in ("=", "<>", "<", "<=", ">", ">="):
            return S.pushable(e.op, self.value(e.left), self.value(e.right))
        v = self.value(e)
        return v.col if v.kind == "bool" else F.lit(False)

    def condition_truth(self, e) -> Column:
        """Inside AND and OR anything is taken for its truth."""
        if isinstance(e, X.Binary) and e.op in ("AND", "OR", "=", "<>", "<", "<=", ">", ">="):
            return self.condition(e)
        return S.truth(self.value(e))

    def exists(self, rows: DataFrame, p: X.Path, how: str) -> DataFrame:
        outer = [v for v in dict.fromkeys(n.var for n in p.nodes) if v and v in self.bound]
        if not outer:
            raise AnalysisError("a pattern in WHERE needs a variable of MATCH")
        inner = Compiler(self.graph, self.compat)
        found = inner.path(None, p)
        keys = found.select(*(F.col(f"{v}__id").alias(f"__k{i}") for i, v in enumerate(outer))).distinct()
        return rows.join(keys, reduce(lambda a, b: a & b, (F.col(f"{v}__id") == F.col(f"__k{i}") for i, v in enumerate(outer))), how)

    def bindings(self, q: X.Query) -> DataFrame:
        rows = None
        for p in q.paths:
            rows = self.path(rows, p)
        return rows if q.where is None else self.where(rows, q.where)

    def result(self, q: X.Query) -> DataFrame:
        for item in q.items:
            self.note(item.expr)
        for e, _ in q.order:
            self.note(e)
        self.note(q.where)
        for v in [v for v in self.needs if v in {i.name for i in q.items} and not self._pattern_var(q, v)]:
            del self.needs[v]
        rows = self.bindings(q)
        names = [i.name if [j.name for j in q.items].index(i.name) == k else f"{i.name}_{k + 1}" for k, i in enumerate(q.items)]
        aliases = {i.name: n for i, n in zip(q.items, names, strict=True)}
        texts = {i.expr: n for i, n in zip(q.items, names, strict=True)}

        def sort_key(e) -> Column | None:
            if isinstance(e, X.Var) and e.name in aliases and e.name not in self.bound:
                return F.col(f"`{aliases[e.name]}`") if not self.compat else F.lit(None)
            return F.col(f"`{texts[e]}`") if e in texts else None

        aggregates = [has_aggregate(i.expr) for i in q.items]
        if any(aggregates):
            keys = [(i, n) for i, n, a in zip(q.items, names, aggregates, strict=True) if not a]
            values = [self.value(i.expr).col.alias(n) for i, n, a in zip(q.items, names, aggregates, strict=True) if a]
            if self.compat:
                out = rows.agg(*values, *(F.first(self.value(i.expr).col).alias(n) for i, n in keys))
            else:
                rows = rows.select("*", *(self.value(i.expr).col.alias(f"__g{k}") for k, (i, _) in enumerate(keys)))
                out = rows.groupBy(*(f"__g{k}" for k in range(len(keys)))).agg(*values) if keys else rows.agg(*values)
                for k, (_, n) in enumerate(keys):
                    out = out.withColumnRenamed(f"__g{k}", n)
            out = out.select(*(f"`{n}`" for n in names))
            order = [(sort_key(e), d) for e, d in q.order]
            if any(c is None for c, _ in order):
                raise AnalysisError("ORDER BY of an aggregation needs a returned expression or alias")
        else:
            items = [self.value(i.expr).col.alias(n) for i, n in zip(q.items, names, strict=True)]
            own = [sort_key(e) for e, _ in q.order]
            hidden = [self.value(e).col.alias(f"__s{k}") for k, ((e, _), c) in enumerate(zip(q.order, own, strict=True)) if c is None]
            out = rows.select(*items, *hidden)
            order = [(F.col(f"__s{k}") if c is None else c, d) for k, ((_, d), c) in enumerate(zip(q.order, own, strict=True))]
        by = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in order]
        if q.distinct:
            if any(c.startswith("__s") for c in out.columns):
                first = F.row_number().over(Window.partitionBy(*(f"`{n}`" for n in names)).orderBy(*by))
                out = out.withColumn("__first", first).where("__first = 1")
            else:
                out = out.distinct()
        if by:
            out = out.orderBy(*by)
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.select(*(f"`{n}`" for n in names))

    @staticmethod
    def _pattern_var(q: X.Query, v: str) -> bool:
        return any(v == x.var for p in q.paths for x in (*p.nodes, *p.edges))


def has_aggregate(e) -> bool:
    if isinstance(e, X.Call):
        return e.name in AGGREGATES or any(map(has_aggregate, e.args))
    if isinstance(e, X.Unary):
        return has_aggregate(e.arg)
    return isinstance(e, X.Binary) and (has_aggregate(e.left) or has_aggregate(e.right))


def run(graph: PropertyGraph, text: str, compat: bool = False):
    q = X.parse(text)
    if q.call:
        from graphspark.plans.procedures import call

        return call(graph, *q.call)
    if q.create or q.delete or q.sets:
        from graphspark.operators.mutate import write_query

        return write_query(graph, q)
    return Compiler(graph, compat).result(q)
