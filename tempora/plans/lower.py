"""Logical plans to DataFrames. What a plan reads of each variable is found first, so that version
resolution carries only those columns. What cannot change between a put and the delete that ends it
(identity, ends, fixed types and labels) is filtered below the resolution, deletes always kept, so it
reaches the scan; a hop that starts from known vertices resolves only what they can reach. Catalyst
does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tempora.functions.expressions import Compiler, ExpressionError, Typed, tag_of
from tempora.functions.lineage import materialize
from tempora.model import LATEST, OPEN, Graph
from tempora.operators import temporal
from tempora.plans import ir


@dataclass(frozen=True)
class Snapshot:
    """What is read where a statement does not say."""

    valid_at: int = LATEST
    tx_at: int = OPEN


def required_columns(plan) -> dict[str, set[str] | None]:
    """For each variable the properties that are read; None if it is used whole."""
    out: dict[str, set[str] | None] = {}

    def visit(x) -> None:
        if isinstance(x, ir.Property) and isinstance(x.of, ir.Variable):
            if out.setdefault(x.of.name, set()) is not None:
                out[x.of.name].add(x.name)
        elif isinstance(x, ir.Variable):
            out[x.name] = None
        elif isinstance(x, tuple):
            for y in x:
                visit(y)
        elif hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                visit(getattr(x, f))

    visit(plan)
    return out


class Lowering:
    def __init__(self, graph: Graph, snapshot: Snapshot, params: dict, needed: dict[str, set[str] | None]):
        self.graph, self.snapshot, self.params, self.needed = graph, snapshot, params, needed
        self.variables: dict[str, T.StructType | T.DataType] = {}
        self.tags: dict[str, str] = {}
        #: The identity of a variable that is looked up, and the variables that stem from one.
        self.known: dict[str, int] = {}
        self.few: set[str] = set()

    # -- reading versions

    def _time(self, t):
        if isinstance(t, ir.Parameter):
            if t.name not in self.params:
                raise ExpressionError(f"parameter ${t.name} is not given")
            t = self.params[t.name]
        if isinstance(t, bool) or not isinstance(t, int):
            raise ExpressionError("a time must be an integer")
        return t

    @staticmethod
    def _among(history: DataFrame, column: str | list[str], keys: DataFrame) -> DataFrame:
        """The puts of a history whose column (one of the columns) is a key, and all deletes; keys has one column."""
        key = keys.columns[0]
        columns = [column] if isinstance(column, str) else column
        marked = keys.distinct().withColumnRenamed(key, "@key").withColumn("@hit", F.lit(True))
        on = F.col(columns[0]) == F.col("@key")
        if len(columns) > 1:  # an equi-join on either, not a join by condition
            ways = history.where(~F.col("tombstone"))
            hit = None
            for c in columns:
                part = ways.join(marked, F.col(c) == F.col("@key"), "left_semi").select("id")
                hit = part if hit is None else hit.unionByName(part)
            marked, on = hit.distinct().withColumnRenamed("id", "@key").withColumn("@hit", F.lit(True)), F.col("id") == F.col("@key")
        return history.join(marked, on, "left").where(F.col("tombstone") | F.col("`@hit`").isNotNull()).select(*history.columns)

    def _versions(self, kind: str, scope: ir.Scope, columns: list[str], identity=None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        history = self.graph.history(kind)
        if identity is not None:
            history = history.where(F.col("id") == identity)
        if narrow is not None:
            history = narrow(history)
        tx = self._time(scope.system[1]) if scope.system and scope.system[0] == "as_of" else self.snapshot.tx_at
        valid = scope.valid
        if scope.system and scope.system[0] == "changes":
            return temporal.system_changes(history, *map(self._time, scope.system[1:])).select("id", *[c for c in columns if c != "id"], "change_kind")
        if valid and valid[0] == "changes":
            return temporal.valid_changes(history, *map(self._time, valid[1:]), tx).select("id", *[c for c in columns if c != "id"], "change_kind")
        if valid and valid[0] == "between":
            return temporal.overlapping(history, *map(self._time, valid[1:]), tx, columns)
        return temporal.visible(history, self._time(valid[1]) if valid else self.snapshot.valid_at, tx, columns)

    def _entities(self, variable: str, kind: str, scope: ir.Scope, extra: list[str], identity=None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One struct column for each visible entity: $id, then what is needed of it; and the extra columns beside it."""
        system = {"version", "valid_from", "valid_to", "tx_time"}
        declared = [p.name for p in self.graph.properties(kind)]
        fixed = ["labels"] if kind == "vertex" else ["src", "dst", "edge_type"]
        need = self.needed.get(variable, set())
        if need is None:
            fields = [*fixed, *declared]
        else:
            fields = [c for c in dict.fromkeys([*declared, *fixed, *sorted(system)]) if c in need]
        changed = bool(scope.system and scope.system[0] == "changes" or scope.valid and scope.valid[0] == "changes")
        rows = self._versions(kind, scope, list(dict.fromkeys([*(f for f in fields if f != "id"), *extra, *(["id"] if "id" in declared else [])])), identity, narrow)
        if changed:
            fields = [*fields, "change_kind"]
        struct = F.struct(F.col("id").alias("$id"), *[F.col(f) for f in fields])
        self.variables[variable] = T.StructType([T.StructField("$id", T.LongType()), *(rows.schema[f] for f in fields)])
        self.tags[variable] = kind if kind == "vertex" else "relationship"
        return rows.select(struct.alias(variable), *[F.col(c).alias(f"@{variable}.{c}") for c in extra])

    # -- expressions

    def compiler(self, df: DataFrame) -> Compiler:
        known = {v: Typed(F.col(f"`{v}`"), self.tags[v], self.variables[v]) for v in self.variables if v in df.columns}
        return Compiler(known, self.params)

    def _typed(self, df: DataFrame, e) -> Typed:
        return self.compiler(df)(e)

    def _name(self, df: DataFrame, alias: str) -> None:
        t = df.schema[alias].dataType
        self.variables[alias], self.tags[alias] = t, tag_of(t)

    # -- nodes

    def lower(self, p) -> DataFrame:
        return getattr(self, "_" + type(p).__name__.lower())(p)

    def _labelled(self, df: DataFrame, variable: str, labels: tuple[str, ...]) -> DataFrame:
        for label in labels:
            df = df.where(F.array_contains(F.col(f"`@{variable}.labels`"), label))
        return df.drop(f"@{variable}.labels")

    @staticmethod
    def _or_deleted(c: Column) -> Column:
        return F.col("tombstone") | c

    def _with_labels(self, labels: tuple[str, ...], then: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
        def narrow(history: DataFrame) -> DataFrame:
            if self.graph.fixed_labels:
                for label in labels:
                    history = history.where(self._or_deleted(F.array_contains("labels", label)))
            return history if then is None else then(history)

        return narrow

    def _with_types(self, types: tuple[str, ...], then: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
        def narrow(history: DataFrame) -> DataFrame:
            if self.graph.fixed_types and types:
                history = history.where(self._or_deleted(F.col("edge_type").isin(*types)))
            return history if then is None else then(history)

        return narrow

    def _nodescan(self, p: ir.NodeScan, identity=None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        rows = self._entities(p.variable, "vertex", p.scope, ["labels"] if p.labels else [], identity, self._with_labels(p.labels, narrow))
        return self._labelled(rows, p.variable, p.labels)

    def _relationshipscan(self, p: ir.RelationshipScan, identity=None) -> DataFrame:
        df = self._entities(p.variable, "edge", p.scope, ["edge_type"] if p.types else [], identity, self._with_types(p.types))
        return df.where(F.col(f"`@{p.variable}.edge_type`").isin(*p.types)).drop(f"@{p.variable}.edge_type") if p.types else df

    def _identity(self, e):
        value = e.value if isinstance(e, ir.Literal) else self.params.get(e.name)
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise ExpressionError("an identity is a positive integer")
        return value

    def _vertexlookup(self, p: ir.VertexLookup) -> DataFrame:
        identity = self._identity(p.id)
        self.known[p.variable] = identity
        self.few.add(p.variable)
        return self._nodescan(ir.NodeScan(p.variable, p.labels, p.scope), identity)

    def _relationshiplookup(self, p: ir.RelationshipLookup) -> DataFrame:
        return self._relationshipscan(ir.RelationshipScan(p.variable, (), p.scope), self._identity(p.id))

    def _expand(self, p: ir.Expand) -> DataFrame:
        left = self.lower(p.input)
        ends = {"out": ["src"], "in": ["dst"], "either": ["src", "dst"]}[p.direction]
        near = None
        if p.source in self.known:
            at = F.lit(self.known[p.source])
            near = lambda h: h.where(self._or_deleted(F.col(ends[0]) == at if len(ends) == 1 else (F.col("src") == at) | (F.col("dst") == at)))
        elif p.source in self.few:
            left = materialize(left, "frontier")  # what is reached so far, so that hops do not repeat each other's plans
            near = lambda h: self._among(h, ends, left.select(F.col(f"`{p.source}`.`$id`").alias("@near")))
        edges = self._entities(p.relationship, "edge", p.scope, ["src", "dst", *(["edge_type"] if p.types else [])], None, self._with_types(p.types, near))
        src, dst, kind = (F.col(f"`@{p.relationship}.{c}`") for c in ("src", "dst", "edge_type"))
        if p.types:
            edges = edges.where(kind.isin(*p.types))
        if p.direction == "either":  # one scan, both ways; a loop once
            ways = F.when(src == dst, F.array(F.struct(src.alias("n"), dst.alias("f")))).otherwise(F.array(F.struct(src.alias("n"), dst.alias("f")), F.struct(dst.alias("n"), src.alias("f"))))
            edges = edges.select(p.relationship, F.explode(ways).alias("@way")).select(F.col(f"`{p.relationship}`"), F.col("`@way`.n").alias("@near"), F.col("`@way`.f").alias("@far"))
        else:
            near, far = (src, dst) if p.direction == "out" else (dst, src)
            edges = edges.select(F.col(f"`{p.relationship}`"), near.alias("@near"), far.alias("@far"))
        out = left.join(edges, F.col(f"`{p.source}`.`$id`") == F.col("`@near`")).drop("@near")
        if p.destination is None:
            return out.drop("@far")
        if p.destination in left.columns:
            return out.where(F.col("`@far`") == F.col(f"`{p.destination}`.`$id`")).drop("@far")
        if self.needed.get(p.destination, set()) is not None and not self.needed.get(p.destination) and not p.labels and p.destination.startswith("@"):
            struct = T.StructType([T.StructField("$id", T.LongType())])
            self.variables[p.destination], self.tags[p.destination] = struct, "vertex"
            if p.source in self.few:
                self.few.add(p.destination)
            return out.withColumn(p.destination, F.struct(F.col("`@far`").alias("$id"))).drop("@far")
        reached = None
        if p.source in self.few:
            self.few.add(p.destination)
            reached = lambda h: self._among(h, "id", out.select("@far"))
        far = self._nodescan(ir.NodeScan(p.destination, p.labels, p.scope), None, reached)
        return out.join(far, F.col("`@far`") == F.col(f"`{p.destination}`.`$id`")).drop("@far")

    def _filter(self, p: ir.Filter) -> DataFrame:
        df = self.lower(p.input)
        return df.where(self._typed(df, p.predicate).column)

    def _predicate(self, left: DataFrame, right: DataFrame, predicate):
        known = {v: Typed(F.col(f"`{v}`"), self.tags[v], self.variables[v]) for v in self.variables if v in left.columns or v in right.columns}
        c = Compiler(known, self.params)
        if isinstance(predicate, ir.Binary) and predicate.op == "=" and all(isinstance(x, (ir.Variable, ir.Property)) for x in (predicate.left, predicate.right)):
            a, b = c(predicate.left), c(predicate.right)
            if a.tag == b.tag and a.tag not in ("list", "map"):  # an equi-join on keys, where NULL meets NULL
                x, y = (a.column["$id"], b.column["$id"]) if a.tag in ("vertex", "relationship") else (a.column, b.column)
                return x.eqNullSafe(y)
        return c(predicate).column

    def _join(self, p: ir.Join) -> DataFrame:
        left, right = self.lower(p.left), self.lower(p.right)
        if p.predicate is None:
            return left.crossJoin(right) if p.kind == "inner" else left.join(right, F.lit(True), p.kind)
        return left.join(right, self._predicate(left, right, p.predicate), p.kind)

    def _subquery(self, p: ir.Subquery) -> DataFrame:
        return self._join(ir.Join(p.input, p.plan, p.kind, p.predicate))

    def _aggregate(self, p: ir.Aggregate) -> DataFrame:
        df = self.lower(p.input)
        keys = [self._grouped(self._typed(df, e)).alias(a) for e, a in p.groups]
        calls = []
        for c in p.calls:
            x = F.lit(1) if c.argument is None else self._grouped(self._typed(df, c.argument))
            if c.function == "count":
                out = F.count_distinct(x) if c.distinct else F.count(x)
            elif c.function == "collect":
                out = F.array_sort(F.collect_set(x) if c.distinct else F.collect_list(x))
            elif c.function == "sum":
                out = F.sum_distinct(x) if c.distinct else F.sum(x)
            elif c.function == "avg":
                out = F.avg(F.when(x.isNotNull(), x)) if not c.distinct else F.sum_distinct(x) / F.count_distinct(x)
            else:
                out = (F.min if c.function == "min" else F.max)(x)
            calls.append(out.alias(c.alias))
        out = df.groupBy(*keys).agg(*calls) if keys else df.agg(*calls)
        for name in out.columns:
            self._name(out, name)
        return out

    @staticmethod
    def _grouped(x: Typed):
        return x.column["$id"] if x.tag in ("vertex", "relationship") else x.column

    def _sort(self, p: ir.Sort) -> DataFrame:
        df = self.lower(p.input)
        keys = []
        for e, descending in p.keys:
            x = self._typed(df, e)
            c = F.array_sort(F.map_entries(x.column)) if x.tag == "map" else x.column
            keys.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
        rest = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if self.tags.get(c) != "map"]
        return df.orderBy(*keys, *rest)

    def _limit(self, p: ir.Limit) -> DataFrame:
        df = self.lower(p.input)
        df = df.offset(p.skip) if p.skip else df
        return df if p.limit is None else df.limit(p.limit)

    def _unwind(self, p: ir.Unwind) -> DataFrame:
        df = self.lower(p.input)
        x = self._typed(df, p.list)
        if x.tag not in ("list", "null", "any"):
            raise ExpressionError(f"a {x.tag} cannot be unwound")
        if p.alias in df.columns:
            raise ExpressionError(f"{p.alias} is bound already")
        out = df.where(F.lit(False)).withColumn(p.alias, F.lit(None)) if x.tag == "null" else df.withColumn(p.alias, F.explode(x.column))
        self._name(out, p.alias)
        return out

    def _project(self, p: ir.Project) -> DataFrame:
        df = self.lower(p.input)
        cols, tags = [], {}
        for e, alias in p.items:
            x = self._typed(df, e)
            c = x.column
            if x.tag in ("vertex", "relationship"):
                names = {"src": "source", "dst": "target", "edge_type": "type"}
                c = F.struct(c["$id"].alias("id"), *[c[f.name].alias(names.get(f.name, f.name)) for f in x.spark.fields if f.name not in ("$id", "id")])
            cols.append(c.alias(alias))
            tags[alias] = x.tag
        out = df.select(*cols)
        for name in out.columns:
            self._name(out, name)
        return out


def lower(plan, graph: Graph, snapshot: Snapshot = Snapshot(), params: dict | None = None) -> DataFrame:
    ir.validate(plan)
    return Lowering(graph, snapshot, params or {}, required_columns(plan)).lower(plan)
