"""Logical plans: expressions, temporal scopes, thirteen kinds of nodes, mutations."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class PlanError(ValueError):
    def __init__(self, message: str):
        super().__init__(f"TG-IR-VALIDATION: {message}")
        self.code = "TG-IR-VALIDATION"


# ---- expressions

@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    of: Any
    name: str


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Unary:
    op: str  # not, negate, is_null
    value: Any


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / = <> < <= > >= and or contains
    left: Any
    right: Any


UNARY = ("not", "negate", "is_null")
BINARY = ("+", "-", "*", "/", "=", "<>", "<", "<=", ">", ">=", "and", "or", "contains")
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
JOINS = ("inner", "left", "left_semi", "left_anti")
DIRECTIONS = ("out", "in", "either")


# ---- scopes: times are integers, Parameters, or None for the session's default

@dataclass(frozen=True)
class Scope:
    """How versions are read. system and valid are None, ('as_of', t), ('between', a, b) or ('changes', a, b)."""

    system: tuple | None = None
    valid: tuple | None = None


# ---- nodes

@dataclass(frozen=True)
class NodeScan:
    variable: str
    labels: tuple[str, ...] = ()
    scope: Scope = Scope()


@dataclass(frozen=True)
class RelationshipScan:
    variable: str
    types: tuple[str, ...] = ()
    scope: Scope = Scope()


@dataclass(frozen=True)
class VertexLookup:
    variable: str
    id: Any
    labels: tuple[str, ...] = ()
    scope: Scope = Scope()


@dataclass(frozen=True)
class RelationshipLookup:
    variable: str
    id: Any
    scope: Scope = Scope()


@dataclass(frozen=True)
class Expand:
    """One hop from source. destination: the far vertex, bound now (fetched from the graph) or before."""

    input: Any
    source: str
    relationship: str
    destination: str | None
    direction: str = "out"
    types: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    scope: Scope = Scope()


@dataclass(frozen=True)
class Filter:
    input: Any
    predicate: Any


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    kind: str = "inner"
    predicate: Any = None


@dataclass(frozen=True)
class AggregateCall:
    function: str
    argument: Any
    alias: str
    distinct: bool = False


@dataclass(frozen=True)
class Aggregate:
    input: Any
    groups: tuple  # of (expression, alias)
    calls: tuple[AggregateCall, ...]


@dataclass(frozen=True)
class Sort:
    input: Any
    keys: tuple  # of (expression, descending)


@dataclass(frozen=True)
class Limit:
    input: Any
    skip: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Unwind:
    input: Any
    list: Any
    alias: str


@dataclass(frozen=True)
class Subquery:
    """Rows of input joined with those of plan, whose predicate may use both sides' variables."""

    input: Any
    plan: Any
    kind: str = "inner"
    predicate: Any = None


@dataclass(frozen=True)
class Project:
    input: Any
    items: tuple  # of (expression, alias)


NODES = (NodeScan, RelationshipScan, VertexLookup, RelationshipLookup, Expand, Filter, Join, Aggregate, Sort, Limit, Unwind, Subquery, Project)


# ---- mutations and programs

@dataclass(frozen=True)
class CreateVertex:
    labels: tuple[str, ...]
    properties: tuple
    valid_from: Any


@dataclass(frozen=True)
class CreateRelationship:
    type: str
    source: str
    destination: str
    properties: tuple
    valid_from: Any


@dataclass(frozen=True)
class SetProperties:
    variable: str
    properties: tuple
    valid_from: Any


@dataclass(frozen=True)
class Delete:
    variable: str
    valid_from: Any


@dataclass(frozen=True)
class Program:
    kind: str  # query, write, analytics, begin, commit, rollback
    plan: Any = None
    mutation: Any = None
    graph: str | None = None
    algorithm: str | None = None
    columns: tuple = ()  # of (name, type, nullable)
    parameters: tuple[str, ...] = field(default=())


def walk(x: Any):
    """x and all plan parts below it."""
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))


def validate(plan: Any) -> Any:
    """Raise PlanError on parts that no engine could run; give the plan back."""
    for x in walk(plan):
        if isinstance(x, Unary) and x.op not in UNARY or isinstance(x, Binary) and x.op not in BINARY:
            raise PlanError(f"unknown operator {x.op!r}")
        if isinstance(x, (Join, Subquery)) and x.kind not in JOINS:
            raise PlanError(f"unknown join {x.kind!r}")
        if isinstance(x, Expand) and x.direction not in DIRECTIONS:
            raise PlanError(f"unknown direction {x.direction!r}")
        if isinstance(x, AggregateCall) and (x.function not in AGGREGATES or x.argument is None and x.function != "count"):
            raise PlanError(f"unknown aggregate {x.function!r}")
        if isinstance(x, Limit) and (x.skip < 0 or x.limit is not None and x.limit < 0):
            raise PlanError("a negative limit")
        names = None
        if isinstance(x, Project):
            names = [a for _, a in x.items]
        elif isinstance(x, Aggregate):
            names = [a for _, a in x.groups] + [c.alias for c in x.calls]
        if names is not None and (not all(names) or len(set(names)) < len(names)):
            raise PlanError("aliases must be unique and not empty")
        if isinstance(x, Scope):
            for axis in (x.system, x.valid):
                if axis and axis[0] != "as_of" and all(isinstance(t, int) for t in axis[1:]) and axis[1] >= axis[2]:
                    raise PlanError("an interval that ends before it starts")
    return plan
