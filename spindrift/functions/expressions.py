"""A restricted Python expression as a Column, with Python's meaning.

One allow-list serves fields, patch conditions and assertions. Kinds are tracked while
translating, so `+` is a sum or a concatenation, equality is null-safe, `//` and `%`
follow the divisor's sign, rounding is half-even, and `and`/`or` return values. Ordering
against null is null (false in a condition). Attributes are one level deep (a parent's
column); names with a leading underscore, keyword arguments and unknown calls are errors.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str  # int, float, decimal, str, bool, date, datetime, array, null, other
    items: tuple = ()


_NUMBERS = ("int", "float", "decimal")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    pairs = ((T.DecimalType, "decimal"), (T.StringType, "str"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.ArrayType, "array"), (T.NullType, "null"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return next((k for c, k in pairs if isinstance(t, c)), "other")


def truthy(v: Value) -> Column:
    zero = {"str": F.length(v.col) > 0, "array": F.size(v.col) > 0, "bool": v.col, "null": F.lit(False)}
    test = zero.get(v.kind, v.col != 0 if v.kind in _NUMBERS else v.col.isNotNull())
    return F.coalesce(test, F.lit(False))


def python_str(v: Value) -> Column:
    if v.kind == "bool":
        s = F.when(v.col, "True").when(~v.col, "False")
    else:
        s = v.col.cast("string")
    return F.coalesce(s, F.lit("None"))


def _mod(a: Value, b: Value) -> Column:
    r = a.col % b.col
    return F.when((r != 0) & ((r < 0) != (b.col < 0)), r + b.col).otherwise(r)


def _wider(*vs: Value) -> str:
    kinds = {v.kind for v in vs} - {"null"}
    if kinds <= {"int", "bool"}:
        return "int" if "int" in kinds else "bool" if kinds else "null"
    if kinds <= {*_NUMBERS, "bool"}:
        return "float" if "float" in kinds else "decimal"
    return kinds.pop() if len(kinds) == 1 else "other"


def _whole_power(x: Column, n: int) -> Column:
    """x to the nth by squaring, exact in longs; beyond them it fails as other arithmetic does."""
    if n == 0:
        return F.when(x.isNotNull(), F.lit(1).cast("long"))
    half = _whole_power(x, n // 2) if n > 1 else None
    return x if half is None else half * half * x if n % 2 else half * half


class Translator:
    def __init__(self, columns: dict[str, Value], attribute: Callable[[str, str], Value] | None = None, where: str = "expression"):
        self.columns, self.attribute, self.where = columns, attribute, where

    def value(self, source: str) -> Value:
        try:
            tree = ast.parse(source.strip(), mode="eval")
        except SyntaxError as e:
            raise ExpressionError(f"{self.where}: {source!r} is not an expression: {e.msg}") from None
        return self._visit(tree.body)

    def fail(self, what: str):
        raise ExpressionError(f"{self.where}: {what}")

    def _visit(self, n: ast.AST) -> Value:
        method = getattr(self, f"_{type(n).__name__.lower()}", None)
        if method is None:
            self.fail(f"{type(n).__name__} is not allowed")
        return method(n)

    # ------------------------------------------------------------ leaves
    def _constant(self, n: ast.Constant) -> Value:
        v = n.value
        if v is None:
            return Value(F.lit(None), "null")
        if isinstance(v, bool):
            return Value(F.lit(v), "bool")
        if isinstance(v, int):
            return Value(F.lit(v), "int")
        if isinstance(v, float):
            return Value(F.lit(v), "float")
        if isinstance(v, str):
            return Value(F.lit(v), "str")
        self.fail(f"a constant of type {type(v).__name__} is not allowed")

    def _name(self, n: ast.Name) -> Value:
        if n.id.startswith("_"):
            self.fail(f"name {n.id!r} is not allowed")
        if n.id in self.columns:
            return self.columns[n.id]
        if n.id in ("null", "true", "false"):
            return self._constant(ast.Constant({"null": None, "true": True, "false": False}[n.id]))
        self.fail(f"unknown name {n.id!r}")

    def _attribute(self, n: ast.Attribute) -> Value:
        if not isinstance(n.value, ast.Name) or n.attr.startswith("_") or n.value.id.startswith("_"):
            self.fail("only entity.field is allowed")
        if self.attribute is None:
            self.fail(f"{n.value.id}.{n.attr}: there are no parents here")
        return self.attribute(n.value.id, n.attr)

    def _list(self, n: ast.List) -> Value:
        items = [self._visit(e) for e in n.elts]
        kind = _wider(*items) if items else "null"
        cast = {"float": "double", "int": "bigint", "str": "string"}.get(kind)
        cols = [i.col.cast(cast) if cast else i.col for i in items]
        return Value(F.array(*cols), "array", tuple(items))

    _tuple = _list

    # ------------------------------------------------------------ operators
    def _unaryop(self, n: ast.UnaryOp) -> Value:
        v = self._visit(n.operand)
        if isinstance(n.op, ast.Not):
            return Value(~truthy(v), "bool")
        if v.kind not in (*_NUMBERS, "bool"):
            self.fail(f"a sign needs a number, not {v.kind}")
        if isinstance(n.op, ast.USub):
            return Value(-v.col, v.kind)
        if isinstance(n.op, ast.UAdd):
            return v
        self.fail(f"{type(n.op).__name__} is not allowed")

    def _binop(self, n: ast.BinOp) -> Value:
        a, b, op = self._visit(n.left), self._visit(n.right), type(n.op)
        if op is ast.Add and a.kind == b.kind and a.kind in ("str", "array"):
            return Value(F.concat(a.col, b.col), a.kind)
        if op is ast.Mult and {a.kind, b.kind} == {"str", "int"}:
            s, k = (a, b) if a.kind == "str" else (b, a)
            return Value(F.repeat(s.col, k.col.cast("int")), "str")
        a, b = (Value(v.col.cast("int"), "int") if v.kind == "bool" else v for v in (a, b))
        if not {a.kind, b.kind} <= {*_NUMBERS, "null"}:
            self.fail(f"{op.__name__} can't take {a.kind} and {b.kind}")
        kind = _wider(a, b)
        if kind == "int":
            a, b = Value(a.col.cast("long"), "int"), Value(b.col.cast("long"), "int")
        if op is ast.Add:
            return Value(a.col + b.col, kind)
        if op is ast.Sub:
            return Value(a.col - b.col, kind)
        if op is ast.Mult:
            return Value(a.col * b.col, kind)
        if op is ast.Div:
            return Value(a.col / b.col, "decimal") if kind == "decimal" else Value(a.col.cast("double") / b.col.cast("double"), "float")
        if op is ast.FloorDiv:
            if kind == "int":
                return Value(((a.col - _mod(a, b)) / b.col).cast("long"), "int")
            return Value(F.floor(a.col / b.col).cast("double" if kind == "float" else "decimal(38,0)"), kind)
        if op is ast.Mod:
            return Value(_mod(a, b), kind)
        if op is ast.Pow:
            if kind == "int" and isinstance(n.right, ast.Constant) and 0 <= n.right.value < 64:
                return Value(_whole_power(a.col, n.right.value), "int")
            return Value(F.pow(a.col.cast("double"), b.col.cast("double")), "float")
        self.fail(f"{op.__name__} is not allowed")

    def _boolop(self, n: ast.BoolOp) -> Value:
        values = [self._visit(v) for v in n.values]
        both = isinstance(n.op, ast.And)
        if any(v.kind == "bool" for v in values) or len({v.kind for v in values} - {"null"}) > 1:
            out = truthy(values[0])
            for v in values[1:]:
                out = out & truthy(v) if both else out | truthy(v)
            return Value(out, "bool")
        out = values[-1].col
        for v in reversed(values[:-1]):
            out = F.when(truthy(v), out if both else v.col).otherwise(v.col if both else out)
        return Value(out, _wider(*values))

    def _equal(self, a: Value, b: Value) -> Column:
        if a.kind == "null" or b.kind == "null":
            return (b if a.kind == "null" else a).col.isNull()
        a, b = (Value(v.col.cast("int"), "int") if v.kind == "bool" and {a.kind, b.kind} & set(_NUMBERS) else v for v in (a, b))
        alike = a.kind == b.kind or {a.kind, b.kind} <= set(_NUMBERS) or {a.kind, b.kind} <= {"date", "datetime", "str"} or "other" in (a.kind, b.kind)
        return a.col.eqNullSafe(b.col) if alike else a.col.isNull() & b.col.isNull()

    def _contains(self, a: Value, b: Value) -> Column:
        if b.items:
            out = F.lit(False)
            for i in b.items:
                out = out | self._equal(a, i)
            return out
        if b.kind == "array":
            return F.coalesce(F.array_contains(b.col, a.col), F.lit(False))
        if a.kind == b.kind == "str":
            return b.col.contains(a.col)
        self.fail(f"'in' needs a list or text, not {b.kind}")

    def _compare(self, n: ast.Compare) -> Value:
        out, left = None, self._visit(n.left)
        for op, right_node in zip(n.ops, n.comparators, strict=True):
            right = self._visit(right_node)
            if isinstance(op, (ast.Eq, ast.Is)):
                c = self._equal(left, right)
            elif isinstance(op, (ast.NotEq, ast.IsNot)):
                c = ~self._equal(left, right)
            elif isinstance(op, ast.In):
                c = self._contains(left, right)
            elif isinstance(op, ast.NotIn):
                c = ~self._contains(left, right)
            else:
                kinds = {left.kind, right.kind} - {"null", "other"}
                if len(kinds) > 1 and not kinds <= {*_NUMBERS, "bool"} and not kinds <= {"date", "datetime", "str"}:
                    self.fail(f"can't order {left.kind} and {right.kind}")
                a, b = (v.col.cast("int") if v.kind == "bool" and kinds != {"bool"} else v.col for v in (left, right))
                c = {ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}[type(op)]()
            out = c if out is None else out & c
            left = right
        return Value(out, "bool")

    def _ifexp(self, n: ast.IfExp) -> Value:
        return self._choose(self._visit(n.test), self._visit(n.body), self._visit(n.orelse))

    def _choose(self, c: Value, a: Value, b: Value) -> Value:
        return Value(F.when(truthy(c), a.col).otherwise(b.col), _wider(a, b))

    # ------------------------------------------------------------ functions
    def _call(self, n: ast.Call) -> Value:
        if not isinstance(n.func, ast.Name) or n.keywords or n.func.id not in FUNCTIONS:
            self.fail("unknown function" + (f" {n.func.id!r}" if isinstance(n.func, ast.Name) else ""))
        args = [self._visit(a) for a in n.args]
        raw = [a.value if isinstance(a, ast.Constant) else -a.operand.value if isinstance(a, ast.UnaryOp) and isinstance(a.op, ast.USub) and isinstance(a.operand, ast.Constant) else None for a in n.args]
        try:
            return FUNCTIONS[n.func.id](self, args, raw)
        except (IndexError, TypeError) as e:
            raise ExpressionError(f"{self.where}: {n.func.id}() got {len(args)} arguments: {e}") from None


def _string(f):
    return lambda t, a, r: Value(f(a[0].col.cast("string"), *r[1:]), "str")


def _int(t, a, r):
    v = a[0]
    if v.kind == "str":
        return Value(tx.strip(v.col).cast("long"), "int")
    return Value(v.col.cast("long"), "int")


def _round(t, a, r):
    places = int(r[1]) if len(a) > 1 else 0
    col = F.bround(a[0].col, places)
    return Value(col.cast("long"), "int") if len(a) == 1 else Value(col, a[0].kind)


def _extreme(many, one):
    def f(t, a, r):
        if len(a) == 1:
            return Value(one(a[0].col), _wider(*a[0].items) if a[0].items else "other")
        return Value(many(*[v.col for v in a]), _wider(*a))

    return f


def _substr(t, a, r):
    s, n = a[0].col.cast("string"), F.length(a[0].col.cast("string"))
    place = lambda v: F.when(v.col < 0, F.greatest(n + v.col, F.lit(0))).otherwise(F.least(v.col, n))
    begin = place(a[1])
    end = place(a[2]) if len(a) > 2 and a[2].kind != "null" and r[2] != 0 else n  # an end of 0 is none
    return Value(F.substring(s, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "str")


def _len(t, a, r):
    return Value((F.size(a[0].col) if a[0].kind == "array" else F.length(a[0].col.cast("string"))).cast("long"), "int")


def _sum(t, a, r):
    kind = _wider(*a[0].items) if a[0].items else "float"
    zero = F.lit(0).cast("long") if kind == "int" else F.lit(0.0)
    return Value(F.aggregate(a[0].col, zero, lambda x, y: x + y), kind)


FUNCTIONS: dict[str, Callable] = {
    "lower": _string(lambda x: F.lower(x)),
    "upper": _string(lambda x: F.upper(x)),
    "title": _string(tx.title),
    "strip": _string(tx.strip),
    "len": _len,
    "str": lambda t, a, r: Value(python_str(a[0]), "str"),
    "int": _int,
    "float": lambda t, a, r: Value((tx.strip(a[0].col) if a[0].kind == "str" else a[0].col).cast("double"), "float"),
    "bool": lambda t, a, r: Value(truthy(a[0]), "bool"),
    "round": _round,
    "abs": lambda t, a, r: Value(F.abs(a[0].col), a[0].kind),
    "min": _extreme(F.least, F.array_min),
    "max": _extreme(F.greatest, F.array_max),
    "sum": _sum,
    "concat": lambda t, a, r: Value(F.concat(*[python_str(v) for v in a]), "str"),
    "join": lambda t, a, r: Value(F.array_join(F.transform(a[1].col, lambda x: x.cast("string")), r[0]), "str"),
    "replace": lambda t, a, r: Value(F.replace(a[0].col.cast("string"), a[1].col, a[2].col), "str"),
    "substr": _substr,
    "slug": _string(tx.slug),
    "coalesce": lambda t, a, r: Value(F.coalesce(*[v.col for v in a]), _wider(*a)),
    "iif": lambda t, a, r: t._choose(a[0], a[1], a[2]),
    "when": lambda t, a, r: t._choose(a[0], a[1], a[2]),
    "hash": lambda t, a, r: Value(F.substring(F.sha2(python_str(a[0]), 256), 1, int(r[1]) if len(a) > 1 else 12), "str"),
    "year": lambda t, a, r: Value(F.year(a[0].col).cast("long"), "int"),
    "month": lambda t, a, r: Value(F.month(a[0].col).cast("long"), "int"),
    "day": lambda t, a, r: Value(F.dayofmonth(a[0].col).cast("long"), "int"),
    "format_date": lambda t, a, r: Value(F.date_format(a[0].col, tx.date_pattern(r[1])), "str"),
    "contains": lambda t, a, r: Value(F.array_contains(a[0].col, a[1].col) if a[0].kind == "array" else a[0].col.contains(a[1].col), "bool"),
    "startswith": lambda t, a, r: Value(a[0].col.startswith(a[1].col), "bool"),
}


def columns_of(schema: T.StructType) -> dict[str, Value]:
    return {f.name: Value(F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in schema.fields}


def names_in(source: str) -> tuple[set[str], set[tuple[str, str]]]:
    """(plain names, entity.field pairs) that an expression reads."""
    tree = ast.parse(source.strip(), mode="eval")
    pairs = {(n.value.id, n.attr) for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    owners = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in owners | called}
    return names - {"null", "true", "false"}, pairs


def translate(source: str, schema: T.StructType, where: str = "expression", attribute=None) -> Column:
    return Translator(columns_of(schema), attribute, where).value(source).col


def condition(source: str, schema: T.StructType, where: str = "condition", attribute=None) -> Column:
    """A predicate: truthiness, with null as false."""
    return truthy(Translator(columns_of(schema), attribute, where).value(source))
