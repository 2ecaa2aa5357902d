"""Plan expressions to Spark columns, with a type tag that decides comparisons at compile time.

Tags: null, boolean, integer, float, bytes, string, list, map, vertex, relationship, any. Values of
different tags are never equal and order by their tags; there is no numeric coercion. Arithmetic is
on integers and fails on overflow and on division by zero, as ANSI mode does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from tempora.plans import ir

# The order of types.
ORDER = {"null": 0, "boolean": 1, "integer": 2, "float": 3, "bytes": 4, "string": 5, "list": 6, "map": 7, "vertex": 8, "relationship": 9}


class ExpressionError(ValueError):
    def __init__(self, message: str):
        super().__init__(f"TG-PLAN: {message}")
        self.code = "TG-PLAN"


@dataclass
class Typed:
    column: Column
    tag: str
    spark: T.DataType | None = None


def tag_of(t: T.DataType) -> str:
    for kind, tag in ((T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.FractionalType, "float"), (T.BinaryType, "bytes"), (T.StringType, "string"), (T.ArrayType, "list"), (T.MapType, "map"), (T.NullType, "null")):
        if isinstance(t, kind):
            return tag
    return "any"


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null", T.NullType())
    if isinstance(value, list):
        items = [literal(v) for v in value]
        return Typed(F.array(*[i.column for i in items]), "list", T.ArrayType(items[0].spark if items else T.NullType()))
    if isinstance(value, dict):
        parts = [c for k in sorted(value) for c in (F.lit(k), literal(value[k]).column)]
        return Typed(F.create_map(*parts), "map")
    kind = {bool: ("boolean", T.BooleanType()), int: ("integer", T.LongType()), float: ("float", T.DoubleType()), str: ("string", T.StringType()), bytes: ("bytes", T.BinaryType())}.get(type(value))
    if kind is None:
        raise ExpressionError(f"no literal of {type(value).__name__}")
    return Typed(F.lit(value).cast(kind[1]), *kind)


class Compiler:
    """Compiles expressions over bound variables: name -> Typed, whose tag vertex or relationship marks a struct."""

    def __init__(self, variables: dict[str, Typed], params: dict):
        self.variables, self.params = variables, params

    def __call__(self, e) -> Typed:
        if isinstance(e, ir.Literal):
            return literal(e.value)
        if isinstance(e, ir.Parameter):
            if e.name not in self.params:
                raise ExpressionError(f"parameter ${e.name} is not given")
            return literal(self.params[e.name])
        if isinstance(e, ir.Variable):
            if e.name not in self.variables:
                raise ExpressionError(f"unknown column {e.name}")
            return self.variables[e.name]
        if isinstance(e, ir.Property):
            return self._property(self(e.of), e.name)
        if isinstance(e, ir.ListOf):
            items = [self(x) for x in e.items]
            return Typed(F.array(*[i.column for i in items]), "list", T.ArrayType(items[0].spark or T.StringType()) if items else T.ArrayType(T.NullType()))
        if isinstance(e, ir.MapOf):
            return Typed(F.create_map(*[c for k, v in e.items for c in (F.lit(k), self(v).column)]), "map")
        if isinstance(e, ir.Unary):
            return self._unary(e.op, self(e.value))
        if isinstance(e, ir.Binary):
            return self._binary(e.op, self(e.left), self(e.right))
        raise ExpressionError(f"no expression {e!r}")

    def _property(self, of: Typed, name: str) -> Typed:
        if of.tag in ("vertex", "relationship"):
            for f in of.spark.fields:
                if f.name == ("$id" if name == "id" and "id" not in of.spark.names else name):
                    return Typed(of.column[f.name], tag_of(f.dataType), f.dataType)
        elif of.tag == "map":
            return Typed(F.try_element_at(of.column, F.lit(name)), "any")
        return literal(None)

    def _boolean(self, x: Typed) -> Column:
        if x.tag not in ("boolean", "null", "any"):
            raise ExpressionError(f"a {x.tag} is no boolean")
        return x.column.cast("boolean")

    def _unary(self, op: str, x: Typed) -> Typed:
        if op == "is_null":
            return Typed(x.column.isNull(), "boolean", T.BooleanType())
        if op == "not":
            return Typed(~self._boolean(x), "boolean", T.BooleanType())
        self._integers(x)
        return Typed(-x.column.cast("bigint"), "integer", T.LongType())

    @staticmethod
    def _integers(*xs: Typed) -> None:
        for x in xs:
            if x.tag not in ("integer", "null", "any"):
                raise ExpressionError(f"arithmetic on a {x.tag}")

    def _binary(self, op: str, a: Typed, b: Typed) -> Typed:
        boolean = lambda c: Typed(c, "boolean", T.BooleanType())
        if op in ("and", "or"):
            x, y = self._boolean(a), self._boolean(b)
            return boolean(x & y if op == "and" else x | y)
        if op in "+-*/":
            self._integers(a, b)
            x, y = a.column.cast("bigint"), b.column.cast("bigint")
            return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y)}[op](), "integer", T.LongType())
        if op == "contains":
            if a.tag == "list":
                return boolean(F.array_contains(a.column, b.column))
            if {a.tag, b.tag} <= {"string", "null", "any"}:
                return boolean(F.contains(a.column.cast("string"), b.column.cast("string")))
            raise ExpressionError(f"a {a.tag} contains nothing")
        return boolean(self._compared(op, a, b))

    def _compared(self, op: str, a: Typed, b: Typed) -> Column:
        neither = a.column.isNull() | b.column.isNull()
        if "null" in (a.tag, b.tag):
            return F.lit(None).cast("boolean")
        if a.tag != b.tag and "any" not in (a.tag, b.tag):  # the types decide
            less = ORDER[a.tag] < ORDER[b.tag]
            known = {"=": False, "<>": True, "<": less, "<=": less, ">": not less, ">=": not less}[op]
            return F.when(neither, F.lit(None)).otherwise(F.lit(known))
        x, y = a.column, b.column
        if a.tag in ("vertex", "relationship"):
            x, y = x["$id"], y["$id"]
        elif a.tag == "map":
            x, y = F.array_sort(F.map_entries(x)), F.array_sort(F.map_entries(y))
        return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
