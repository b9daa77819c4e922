"""A restricted expression language, compiled from its syntax tree to one Column.

Names are columns or parameters; only listed node types and functions are accepted, so an expression can read but do
nothing else. Each step knows the type of its operands, which the analyzer tells without running anything, so that
``len``, ``+``, ``in``, slices and conditions do what fits a text, a list, a mapping or a number. Semantics follow the
language of the expressions: // and % take the sign of the divisor and are exact on integers, round is half to even,
and/or give booleans, comparisons chain, null equals null, and an empty or zero value is false.
"""

from __future__ import annotations

import ast
import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """The expression uses something that the language does not have."""


@dataclass
class Value:
    """A column with its type; ``constant`` is its value if it is written out."""

    column: Column
    type: T.DataType
    constant: object = None

    @property
    def kind(self) -> str:
        kinds = {"text": T.StringType, "list": T.ArrayType, "map": T.MapType, "row": T.StructType, "bool": T.BooleanType, "null": T.NullType, "integer": T.IntegralType}
        return next((k for k, t in kinds.items() if isinstance(self.type, t)), "number")


def truth_of(c: Column, kind: str) -> Column:
    """False for null, false, zero and empty."""
    tests = {"bool": c, "integer": c != 0, "number": c != 0, "text": F.length(c) > 0, "list": F.size(c) > 0, "map": F.size(c) > 0, "row": c.isNotNull(), "null": F.lit(False)}
    return F.coalesce(tests[kind], F.lit(False))


def text_of(c: Column, kind: str) -> Column:
    plain = F.when(c, "True").otherwise("False") if kind == "bool" else c.cast("string")
    return F.when(c.isNull(), "None").otherwise(plain)


def floor_mod(a: Column, b: Column, whole: bool) -> Column:
    return (a % b + b) % b if whole else a - b * F.floor(a / b)


def floor_div(a: Column, b: Column, whole: bool) -> Column:
    return F.call_function("div", a - floor_mod(a, b, True), b) if whole else F.floor(a / b).cast("double")


def when_of(c: Column) -> Column:
    """A timestamp without zone from an ISO text."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(F.trim(c), r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", ""), "T", " "))


def date_add(value: Column, days: Column | None = None, hours: Column | None = None, minutes: Column | None = None) -> Column:
    """A date of ten characters stays one; another text keeps its zone as it is written, Z as +00:00."""
    zero, value = F.lit(0), F.trim(value)
    moved = when_of(value) + F.make_dt_interval(*(zero if x is None else x for x in (days, hours, minutes)))
    zone = F.regexp_replace(F.regexp_extract(value, r"T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})$", 1), "^Z$", "+00:00")
    return F.when(F.length(value) == 10, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), zone))


def counted(values: Column) -> Column:
    keys = F.array_distinct(values)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda v: v.eqNullSafe(k)))))


def arg_extreme(counts: Column, sign: int) -> Column:
    """The key of the greatest (1) or least (-1) value; of equal ones the least key as text."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((e["value"] * -sign).alias("v"), e["key"].cast("string").alias("t"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def resolved(at: Column, size: Column) -> Column:
    """A slice bound within 0 and ``size``; a negative one counts from the end."""
    return F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(F.least(at, size)).cast("int")


_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_WORDS = {"null": None, "true": True, "false": False}


class _Compiler:
    def __init__(self, names: dict[str, Column | Value], functions: dict[str, Callable[..., Column]], frame: DataFrame) -> None:
        self.names, self.functions, self.frame = names, functions, frame

    def typed(self, column: Column, constant: object = None) -> Value:
        return Value(column, self.frame.select(column).schema[0].dataType, constant)

    def apply(self, f: Callable[..., Column], *args: Value, **named: Value) -> Value:
        """``f`` of the columns; its type is that of ``f`` of nulls of the same types, as loop names have no type of their own."""
        def null(v: Value) -> Column:
            return v.column if v.constant is not None else F.lit(None).cast(v.type)

        return Value(f(*(a.column for a in args), **{k: v.column for k, v in named.items()}), self.frame.select(f(*map(null, args), **{k: null(v) for k, v in named.items()})).schema[0].dataType)

    def truth(self, v: Value) -> Value:
        return Value(truth_of(v.column, v.kind), T.BooleanType())

    def go(self, node: ast.expr) -> Value:
        found = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if found is None:
            raise ExpressionError(f"{type(node).__name__} is not part of the language")
        return found(node)

    def on_constant(self, node: ast.Constant) -> Value:
        return self.typed(F.lit(node.value), node.value)

    def on_name(self, node: ast.Name) -> Value:
        if node.id in self.names:
            found = self.names[node.id]
            return found if isinstance(found, Value) else self.typed(found)
        if node.id in _WORDS:
            return self.typed(F.lit(_WORDS[node.id]), _WORDS[node.id])
        raise ExpressionError(f"unknown name {node.id}")

    def on_binop(self, node: ast.BinOp) -> Value:
        a, b, op = self.go(node.left), self.go(node.right), type(node.op)
        whole, kinds = a.kind == b.kind == "integer", {a.kind, b.kind}
        if op is ast.Add:
            return self.apply(F.concat if kinds & {"text", "list"} else lambda x, y: x + y, a, b)
        if op is ast.Mult and kinds & {"text", "list"}:
            many, n = (a, b) if a.kind in ("text", "list") else (b, a)
            return self.apply((lambda x, k: F.repeat(x, k.cast("int"))) if many.kind == "text" else (lambda x, k: F.flatten(F.array_repeat(x, k.cast("int")))), many, n)
        plain = {ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: lambda x, y: x / y, ast.FloorDiv: lambda x, y: floor_div(x, y, whole), ast.Mod: lambda x, y: floor_mod(x, y, whole)}
        if op is ast.Pow:
            power = isinstance(b.constant, int) and b.constant >= 0 and whole
            return self.apply(lambda x, y: F.pow(x, y).cast("long") if power else F.pow(x, y), a, b)
        if op not in plain:
            raise ExpressionError("unknown operator")
        return self.apply(plain[op], a, b)

    def on_unaryop(self, node: ast.UnaryOp) -> Value:
        value = self.go(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~self.truth(value).column, T.BooleanType())
        if isinstance(node.operand, ast.Constant) and isinstance(node.op, ast.USub) and value.constant is not None:
            return self.typed(F.lit(-value.constant), -value.constant)
        return self.apply(lambda c: -c, value) if isinstance(node.op, ast.USub) else value

    def on_boolop(self, node: ast.BoolOp) -> Value:
        parts = [self.truth(self.go(v)).column for v in node.values]
        return Value(reduce(lambda a, b: a & b if isinstance(node.op, ast.And) else a | b, parts), T.BooleanType())

    def on_compare(self, node: ast.Compare) -> Value:
        sides = [self.go(x) for x in (node.left, *node.comparators)]
        found = (self.compared(op, a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False))
        return Value(reduce(lambda a, b: a & b, found), T.BooleanType())

    def compared(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            inside = self.holds(b, a)
            return inside if isinstance(op, ast.In) else ~inside
        if isinstance(op, (ast.Eq, ast.Is, ast.NotEq, ast.IsNot)):
            same = a.column.eqNullSafe(b.column)
            return same if isinstance(op, (ast.Eq, ast.Is)) else ~same
        return _COMPARE[type(op)](a.column, b.column)

    def holds(self, whole: Value, part: Value) -> Column:
        """Membership of a list or of a mapping's keys, or a part of a text; nothing is in null."""
        if whole.kind == "list":
            found = F.exists(whole.column, lambda v: v.eqNullSafe(part.column))
        elif whole.kind == "map":
            found = F.map_contains_key(whole.column, part.column)
        elif whole.kind == "row":
            found = part.column.isin(whole.type.names)
        else:
            found = F.contains(whole.column.cast("string"), part.column.cast("string"))
        return F.coalesce(found, F.lit(False))

    def on_ifexp(self, node: ast.IfExp) -> Value:
        test = self.truth(self.go(node.test)).column
        a, b = self.go(node.body), self.go(node.orelse)
        return Value(F.when(test, a.column).otherwise(b.column), self.apply(F.coalesce, a, b).type)

    def on_call(self, node: ast.Call) -> Value:
        if not isinstance(node.func, ast.Name):
            raise ExpressionError("only listed functions may be called")
        own = getattr(self, f"call_{node.func.id}", None)
        if own is None and node.func.id not in self.functions:
            raise ExpressionError("only listed functions may be called")
        args, named = [self.go(a) for a in node.args], {k.arg: self.go(k.value) for k in node.keywords}
        if node.func.id in self.functions:
            return self.apply(self.functions[node.func.id], *args, **named)
        return own(*args, **named)

    # functions whose work depends on the types of what they are given
    def call_len(self, v: Value) -> Value:
        return self.apply(F.length if v.kind == "text" else F.size, v)

    def call_sum(self, v: Value) -> Value:
        whole = isinstance(v.type.elementType, (T.IntegralType, T.NullType))
        return self.apply(lambda c: F.aggregate(c.cast("array<long>" if whole else "array<double>"), F.lit(0).cast("long") if whole else F.lit(0.0), lambda a, x: a + x), v)

    def call_any(self, v: Value) -> Value:
        kind = Value(v.column, v.type.elementType).kind
        return self.apply(lambda c: F.exists(c, lambda x: truth_of(x, kind)), v)

    def call_all(self, v: Value) -> Value:
        kind = Value(v.column, v.type.elementType).kind
        return self.apply(lambda c: F.forall(c, lambda x: truth_of(x, kind)), v)

    def call_max(self, *v: Value) -> Value:
        return self.apply(F.greatest if len(v) > 1 else F.array_max, *v)

    def call_min(self, *v: Value) -> Value:
        return self.apply(F.least if len(v) > 1 else F.array_min, *v)

    def call_round(self, v: Value, digits: Value | None = None) -> Value:
        if digits is None:
            return self.apply(lambda c: F.bround(c).cast("long"), v)
        if not isinstance(digits.constant, int):
            raise ExpressionError("the digits of round are written out")
        return self.apply(lambda c: F.bround(c, digits.constant), v)

    def call_bool(self, v: Value) -> Value:
        return self.truth(v)

    def call_str(self, v: Value) -> Value:
        return Value(text_of(v.column, v.kind), T.StringType())

    def call_lower(self, v: Value) -> Value:
        return Value(F.lower(text_of(v.column, v.kind)), T.StringType())

    def call_upper(self, v: Value) -> Value:
        return Value(F.upper(text_of(v.column, v.kind)), T.StringType())

    def call_strip(self, v: Value) -> Value:
        return Value(F.regexp_replace(text_of(v.column, v.kind), r"^\s+|\s+$", ""), T.StringType())

    def call_list(self, v: Value | None = None) -> Value:
        if v is None:
            return self.typed(F.array())
        return v if v.kind == "list" else self.apply(F.map_keys if v.kind == "map" else lambda c: F.filter(F.split(c, ""), lambda x: x != ""), v)

    call_tuple = call_list

    def call_set(self, v: Value | None = None) -> Value:
        return self.apply(F.array_distinct, self.call_list(v))

    def call_dict(self, v: Value | None = None, **named: Value) -> Value:
        if v is not None:
            return v if v.kind == "map" else self.apply(F.map_from_entries, v)
        return self.apply(lambda *c: F.create_map(*(x for k, y in zip(named, c, strict=True) for x in (F.lit(k), y))), *named.values())

    def call_contains(self, whole: Value, part: Value) -> Value:
        return Value(self.holds(whole, part), T.BooleanType())

    def call_first(self, v: Value, other: Value | None = None) -> Value:
        if other is None:
            return self.apply(lambda c: F.get(c, F.lit(0)), v)
        return self.apply(lambda c, d: F.when(F.size(c) > 0, F.get(c, F.lit(0))).otherwise(d), v, other)

    def call_pick(self, row: Value, key: Value, other: Value | None = None) -> Value:
        other = other or self.typed(F.lit(None))
        if row.kind == "row":
            return self.apply(lambda r: r[key.constant], row) if key.constant in row.type.names else other
        if row.kind != "map":
            return other
        return self.apply(lambda r, k, d: F.when(F.map_contains_key(r, k), r[k]).otherwise(d), row, key, other)

    def call_pluck(self, rows: Value, key: Value) -> Value:
        return self.apply(lambda c: F.transform(c, lambda r: r[key.constant]), rows)

    def call_count_by(self, rows: Value, key: Value | None = None) -> Value:
        return self.apply(counted, rows if key is None else self.call_pluck(rows, key))

    def call_fmt(self, template: Value, *args: Value, **named: Value) -> Value:
        if not isinstance(template.constant, str):
            raise ExpressionError("a template is written out")
        parts, n = [], 0
        for text, field, spec, conversion in string.Formatter().parse(template.constant):
            parts.append(F.lit(text))
            if field is None:
                continue
            if spec or conversion:
                raise ExpressionError("templates have no format specifications")
            given = args[n] if not field else args[int(field)] if field.isdigit() else named[field]
            n += not field
            parts.append(text_of(given.column, given.kind))
        return Value(F.concat(F.lit(""), *parts), T.StringType())

    def on_subscript(self, node: ast.Subscript) -> Value:
        value = self.go(node.value)
        text = value.kind == "text"
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise ExpressionError("slices have no step")
            bounds = [self.go(x) if x is not None else None for x in (node.slice.lower, node.slice.upper)]

            def cut(c: Column, *given: Column) -> Column:
                size, given = F.length(c) if text else F.size(c), list(given)
                start = resolved(given.pop(0), size) if bounds[0] else F.lit(0)
                end = resolved(given.pop(0), size) if bounds[1] else size
                return (F.substring if text else F.slice)(c, start + 1, F.greatest(end - start, F.lit(0)))

            return self.apply(cut, value, *(x for x in bounds if x))
        at = self.go(node.slice)
        if value.kind == "row":
            return self.apply(lambda r: r[at.constant], value)
        if value.kind == "map":
            return self.apply(lambda m, k: m[k], value, at)
        if text:
            return self.apply(lambda c, i: F.when((i < F.length(c)) & (i >= -F.length(c)), F.substring(c, F.when(i >= 0, i + 1).otherwise(i).cast("int"), F.lit(1))).otherwise(F.raise_error(F.lit("index out of range"))), value, at)
        return self.apply(lambda c, i: F.element_at(c, F.when(i >= 0, i + 1).otherwise(i).cast("int")), value, at)

    def on_list(self, node: ast.List) -> Value:
        return self.apply(F.array, *map(self.go, node.elts))

    on_tuple = on_list

    def on_set(self, node: ast.Set) -> Value:
        return self.apply(lambda *c: F.array_distinct(F.array(*c)), *map(self.go, node.elts))

    def on_dict(self, node: ast.Dict) -> Value:
        return self.apply(F.create_map, *(self.go(x) for pair in zip(node.keys, node.values, strict=True) for x in pair))

    def on_listcomp(self, node: ast.ListComp) -> Value:
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise ExpressionError("a comprehension has one loop over one name")
        loop = node.generators[0]
        values = self.call_list(self.go(loop.iter))
        item = values.type.elementType

        def inner(v: Column) -> _Compiler:
            return _Compiler({**self.names, loop.target.id: Value(v, item)}, self.functions, self.frame)

        out = values.column
        for test in loop.ifs:
            out = F.filter(out, _each(inner, test, True))
        made = inner(F.lit(None).cast(item)).go(node.elt)
        return Value(F.transform(out, _each(inner, node.elt)), T.ArrayType(made.type))

    on_generatorexp = on_listcomp


def _each(inner: Callable[[Column], _Compiler], node: ast.expr, test: bool = False) -> Callable[[Column], Column]:
    def of(v: Column) -> Column:
        c = inner(v)
        return (c.truth(c.go(node)) if test else c.go(node)).column

    return of


#: Functions that need not know a type; those that do are methods of the compiler.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "size": F.size, "abs": F.abs, "int": lambda c: c.cast("long"), "float": lambda c: c.cast("double"), "sorted": F.array_sort, "unique": F.array_distinct,
    "argmax": lambda m: arg_extreme(m, 1), "argmin": lambda m: arg_extreme(m, -1), "date_add": date_add, "date_of": lambda v: F.date_format(when_of(v), "yyyy-MM-dd"),
    "time_of": lambda v: F.date_format(when_of(v), "HH:mm"), "weekday_of": lambda v: F.date_format(when_of(v), "EEEE"),
    "at_time": lambda v, clock: F.concat(F.substring(F.trim(v), 1, 10), F.lit("T"), F.lpad(F.split_part(clock, F.lit(":"), F.lit(1)), 2, "0"), F.lit(":"), F.lpad(F.split_part(clock, F.lit(":"), F.lit(2)), 2, "0"), F.lit(":00")),
}


def compile_expression(text: str, names: dict[str, Column], functions: dict[str, Callable[..., Column]] | None = None, frame: DataFrame | None = None) -> Column:
    """The Column of ``text``; ``functions`` are added to the language's own.

    ``frame`` is the table that the columns in ``names`` belong to; it is only asked for their types. It may be left
    out if they are literals.
    """
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as error:
        raise ExpressionError(str(error)) from error
    if frame is None and (session := SparkSession.getActiveSession()) is not None:
        frame = session.range(1)
    return _Compiler(names, {**FUNCTIONS, **(functions or {})}, frame).go(tree.body).column
