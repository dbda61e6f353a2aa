"""Typed scalar rules of the query language as column builders.

A value is a column and its kind: int, float, str, bool, list, json or null. Logic is two-valued: null equals null, null
is smaller than anything else, and a null condition is false.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.errors import AnalysisError


class Value(NamedTuple):
    col: Column
    kind: str
    const: Any = None  # the Python value of a literal that isn't null


NUMERIC = ("int", "float")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "list"
    return "str"


SPARK = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "json": "string", "null": "string"}


def literal(v: Any) -> Value:
    if v is None:
        return Value(F.lit(None).cast("string"), "null")
    if isinstance(v, bool):
        return Value(F.lit(v), "bool", v)
    if isinstance(v, int):
        return Value(F.lit(v).cast("bigint"), "int", v)
    if isinstance(v, float):
        return Value(F.lit(v), "float", v)
    return Value(F.lit(v), "str", v)


def null() -> Value:
    return literal(None)


def _text(v: Value) -> Column:
    """JSON text, by which values of different kinds are ordered."""
    if v.kind == "str":
        return F.concat(F.lit('"'), v.col, F.lit('"'))
    return F.to_json(v.col) if v.kind == "list" else v.col.cast("string")


def _aligned(a: Value, b: Value) -> tuple[Column, Column] | None:
    if a.kind == b.kind:
        return a.col, b.col
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col.cast("double"), b.col.cast("double")
    return None


def equal(a: Value, b: Value) -> Column:
    if "null" in (a.kind, b.kind):
        return a.col.isNull() & b.col.isNull()
    pair = _aligned(a, b)
    return pair[0].eqNullSafe(pair[1]) if pair else a.col.isNull() & b.col.isNull()


def less(a: Value, b: Value) -> Column:
    x, y = _aligned(a, b) or (_text(a), _text(b))
    if a.kind == "null":
        return b.col.isNotNull()
    if b.kind == "null":
        return F.lit(False)
    if b.const is not None:
        return x.isNull() | (x < y)
    if a.const is not None:
        return y.isNotNull() & (x < y)
    return F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(x < y)


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    if op == "<":
        return less(a, b)
    if op == ">":
        return less(b, a)
    return ~less(b, a) if op == "<=" else ~less(a, b)


def pushable(op: str, a: Value, b: Value) -> Column:
    """The same as a filter, where null is as good as false: simple predicates reach the scan."""
    flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    if a.const is not None and b.const is None:
        a, b, op = b, a, flip.get(op, op)
    pair = _aligned(a, b)
    if b.const is None or a.kind == "null" or pair is None:
        return compare(op, a, b)
    x, y = pair
    if op == "=":
        return x == y
    if op == "<>":
        return x.isNull() | (x != y)
    if op == ">":
        return x > y
    if op == ">=":
        return x >= y
    return x.isNull() | ((x < y) if op == "<" else (x <= y))


def truth(v: Value) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind in NUMERIC:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "str":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "list":
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return F.lit(False) if v.kind == "null" else v.col.isNotNull()


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str") if op == "+" else null()
    if not (a.kind in NUMERIC and b.kind in NUMERIC):
        return null()
    whole = a.kind == b.kind == "int"
    x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op == "+":
        out = F.try_add(x, y)
    elif op == "-":
        out = F.try_subtract(x, y)
    elif op == "*":
        out = F.try_multiply(x, y)
    elif op == "/":
        out = F.when(y != 0, F.call_function("div", x, y)) if whole else F.try_divide(x, y)
    else:
        out = F.when(y != 0, x % y)
    return Value(out, "int" if whole else "float")


def negative(v: Value) -> Value:
    if v.const is not None and v.kind in NUMERIC:
        return literal(-v.const)
    return Value(-v.col, v.kind) if v.kind in NUMERIC else null()


def to_string(v: Value) -> Value:
    text = F.to_json(v.col) if v.kind == "list" else v.col.cast("string")
    return Value(F.coalesce(text, F.lit("null")), "str")


def to_integer(v: Value) -> Value:
    if v.kind == "int":
        return v
    if v.kind == "float":
        return Value(F.expr("NULL").cast("bigint") if v.col is None else F.when(F.abs(v.col) < 9.2e18, v.col.cast("bigint")), "int")
    if v.kind == "str":
        return Value(F.when(v.col.rlike(r"^[+-]?\d+$"), v.col.try_cast("bigint")), "int")
    return Value(F.lit(None).cast("bigint"), "int")


def to_float(v: Value) -> Value:
    if v.kind in NUMERIC:
        return Value(v.col.cast("double"), "float")
    return Value(F.when(v.col.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), v.col.try_cast("double")), "float") if v.kind == "str" else Value(F.lit(None).cast("double"), "float")


def to_boolean(v: Value) -> Value:
    if v.kind == "bool":
        return v
    return Value(F.when(F.lower(v.col) == "true", True).when(F.lower(v.col) == "false", False), "bool") if v.kind == "str" else Value(F.lit(None).cast("boolean"), "bool")


def string_test(op: str, a: Value, b: Value) -> Column:
    if not (a.kind in ("str", "null") and b.kind in ("str", "null")):
        raise AnalysisError(f"{op} needs strings")
    test = {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op]
    return F.coalesce(test(a.col, b.col), F.lit(False))
