"""The session: named graphs, text queries and plans, writes and algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.model import Graph
from tempora.operators import analytics, temporal
from tempora.plans import ir
from tempora.plans.language import LanguageError, compile
from tempora.plans.lower import Snapshot, lower


class GraphSession:
    def __init__(self, spark: SparkSession, default: Graph | None = None):
        self.spark, self.default = spark, default
        self.graphs: dict[str, Graph] = {}
        self.writers: dict[str | None, object] = {}
        self.staged: list | None = None
        self.starts: dict = {}

    def register(self, name: str, graph: Graph) -> "GraphSession":
        self.graphs[name] = graph
        return self

    def attach_writer(self, writer, name: str | None = None) -> "GraphSession":
        """Let CREATE, SET and DELETE go to a GraphWriter."""
        self.writers[name] = writer
        return self

    def graph(self, name: str | None = None) -> Graph:
        if name in self.writers:
            return self.writers[name].graph()
        g = self.default if name is None else self.graphs.get(name)
        if g is None:
            raise LanguageError("UNKNOWN-GRAPH", f"no graph {name}")
        return g

    def query(self, text: str, params: dict | None = None, valid_at: int | None = None, tx_at: int | None = None) -> DataFrame | None:
        """Run a statement. Reads give a DataFrame, writes and boundaries None."""
        program = compile(text, {*self.graphs, *(n for n in self.writers if n)})
        params = params or {}
        missing = [p for p in program.parameters if p not in params]
        if missing:
            raise LanguageError("PARAMETER", "not given: " + ", ".join("$" + m for m in missing))
        default = Snapshot()
        snapshot = Snapshot(default.valid_at if valid_at is None else valid_at, default.tx_at if tx_at is None else tx_at)
        writer = self.writers.get(program.graph)
        if self.staged is not None and writer is not None and tx_at is None:  # what a transaction reads is what was there when it began
            snapshot = Snapshot(snapshot.valid_at, self.starts.setdefault(writer, writer.frontier()))
        if program.kind == "query":
            return lower(program.plan, self.graph(program.graph), snapshot, params)
        if program.kind == "analytics":
            return self.analytics(program.algorithm, program.graph, snapshot)
        if program.kind == "write":
            return self._write(program, params, snapshot)
        if program.kind == "begin":
            if self.staged is not None:
                raise LanguageError("TRANSACTION", "a transaction is open")
            self.staged, self.starts = [], {w: w.frontier() for w in self.writers.values()}
        elif self.staged is None:
            raise LanguageError("TRANSACTION", "no transaction is open")
        else:
            staged, self.staged = self.staged, None
            if program.kind == "commit":
                for writer in dict.fromkeys(w for w, _ in staged):
                    writer.commit([m for w, part in staged if w is writer for m in part], self.starts[writer])
        return None

    def plan(self, plan, params: dict | None = None, graph: str | None = None, snapshot: Snapshot = Snapshot()) -> DataFrame:
        return lower(plan, self.graph(graph), snapshot, params)

    def analytics(self, name: str, graph: str | None = None, snapshot: Snapshot = Snapshot(), **request) -> DataFrame:
        """Run an algorithm of the closed catalog over what is visible at the snapshot."""
        g = self.graph(graph)
        edges = temporal.visible(g.edges, snapshot.valid_at, snapshot.tx_at, ["src", "dst", *(p.name for p in g.edge_properties)])
        vertices = temporal.visible(g.vertices, snapshot.valid_at, snapshot.tx_at, [])
        return analytics.run(name, analytics.Projection(vertices, edges), **request)

    def _write(self, program: ir.Program, params: dict, snapshot: Snapshot) -> None:
        writer = self.writers.get(program.graph)
        if writer is None:
            raise LanguageError("READ-ONLY", "the graph has no writer")
        start = writer.frontier()
        rows = writer.mutations_of(program, params, snapshot)
        if self.staged is not None:
            self.staged.append((writer, rows))
        else:
            writer.commit(rows, start)
