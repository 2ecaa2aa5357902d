"""Writes: mutations, first-committer-wins conflicts, overlay checks, and commits to an append-only store.

A commit writes its rows as new Parquet batches and then publishes a manifest under the next
number; readers see the batches of the last manifest, so a commit is there as a whole or not at
all. Publishing a number that is taken fails, and the writer that was first has won; the batches
of the loser are removed. A manifest names the batches of its own commit apart from those that
are there in all, which is what a change feed follows: compaction adds none.

A request key is in its commit's manifest, and has a file of its own besides. A writer first
writes that file for the last manifest if it is missing, so the files know all but the last
commit's key and a commit reads one small file for its own.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tempora.functions.expressions import Compiler, Typed
from tempora.functions.lineage import materialize, numbered, release
from tempora.model import OPEN, Graph, PropertySpec
from tempora.operators import temporal
from tempora.plans import ir
from tempora.plans.lower import Lowering, Snapshot, required_columns
from tempora.sources.files import Folder

MAX_MUTATIONS = 4096


class TransactionError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"TG-TX-{code}: {message}")
        self.code = f"TG-TX-{code}"


def conflicts(mutations: DataFrame, committed: DataFrame, start_tx: int) -> DataFrame:
    """Mutations (id, valid_from, valid_to, tombstone) that meet a record of the same identity committed after start_tx; a delete meets all of it."""
    later = committed.where(F.col("tx_time") > F.lit(start_tx))
    m, c = mutations.alias("m"), later.alias("c")
    meets = F.col("m.tombstone") | F.col("c.tombstone") | temporal.overlaps(F.col("m.valid_from"), F.col("m.valid_to"), F.col("c.valid_from"), F.col("c.valid_to"))
    return m.join(c, (F.col("m.id") == F.col("c.id")) & meets, "left_semi")


def overlay_faults(staged: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Identities of a batch that are put and deleted, or have a version twice (live versions of theirs included), or overlapping puts; as id, fault."""
    by = staged.groupBy("id").agg(F.max(F.col("tombstone").cast("int")).alias("dead"), F.max((~F.col("tombstone")).cast("int")).alias("live"))
    both = by.where("dead = 1 and live = 1").select("id", F.lit("PUT-AND-DELETE").alias("fault"))
    puts = staged.where(~F.col("tombstone")).select("id", "version", "valid_from", "valid_to")
    versions = staged.select("id", "version")
    if live is not None:
        versions = versions.unionByName(live.join(puts.select("id", "version").distinct(), ["id", "version"], "left_semi").select("id", "version").distinct())
    twice = versions.groupBy("id", "version").count().where("count > 1").select("id", F.lit("DUPLICATE-VERSION").alias("fault"))
    a, b = puts.alias("a"), puts.alias("b")
    meet = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.version") < F.col("b.version")) & temporal.overlaps(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to")))
    return both.unionByName(twice).unionByName(meet.select("a.id", F.lit("OVERLAPPING-VERSIONS").alias("fault"))).distinct()


def moved_edges(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Edges whose ends or type differ from those of their other live versions."""
    puts = staged.where(~F.col("tombstone")).select("id", "src", "dst", "edge_type")
    both = puts.unionByName(live.join(puts.select("id").distinct(), "id", "left_semi").select("id", "src", "dst", "edge_type"))
    return both.groupBy("id").agg(F.count_distinct(F.struct("src", "dst", "edge_type")).alias("n")).where("n > 1").select("id")


def uncovered_edges(edges: DataFrame, live_edges: DataFrame, vertices: DataFrame, live_vertices: DataFrame) -> DataFrame:
    """Edges that outlive one of their ends: staged ones, and live ones whose end the batch deletes. All that counts of an end is what is left of it after the batch."""
    gone = vertices.where("tombstone").select("id").distinct()
    left = live_edges.join(edges.where("tombstone").select("id").distinct(), "id", "left_anti")
    hit = left.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(left.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi"), allowMissingColumns=True)
    columns = ["id", "version", "src", "dst", "valid_from", "valid_to"]
    checked = edges.where(~F.col("tombstone")).select(*columns).unionByName(hit.select(*columns)).distinct()
    ends = checked.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = live_vertices.join(gone, "id", "left_anti").join(ends, "id", "left_semi").select("id", "valid_from", "valid_to")
    known = known.unionByName(vertices.where(~F.col("tombstone")).select("id", "valid_from", "valid_to"))
    return temporal.covered(checked, known).where(~F.col("covered")).select("id").distinct()


def faults(staged: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """All that speaks against a batch (by kind) on top of a graph: entity, id, fault."""
    none = lambda kind: graph.history(kind).limit(0)
    live = {k: temporal.alive(graph.history(k)) for k in ("vertex", "edge")}
    out = None
    for kind, df in staged.items():
        part = overlay_faults(df, live[kind])
        if kind == "edge":
            part = part.unionByName(moved_edges(df, live[kind]).withColumn("fault", F.lit("ENDPOINTS")))
        part = part.select(F.lit(kind).alias("entity"), "id", "fault")
        out = part if out is None else out.unionByName(part)
    torn = uncovered_edges(staged.get("edge", none("edge")), live["edge"], staged.get("vertex", none("vertex")), live["vertex"])
    torn = torn.select(F.lit("edge").alias("entity"), "id", F.lit("COVERAGE").alias("fault"))
    return torn if out is None else out.unionByName(torn)


class GraphWriter:
    def __init__(self, spark: SparkSession, path: str, vertex_properties: list[PropertySpec], edge_properties: list[PropertySpec]):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, path)
        self.empty = Graph(None, None, vertex_properties, edge_properties)

    # -- reading

    def manifest(self) -> dict:
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        return self.folder.read(f"manifests/{names[-1]}") if names else self.nothing()

    @staticmethod
    def nothing() -> dict:
        """The manifest of a store without commits."""
        return {"number": 0, "tx_time": 0, "log_index": 0, "batches": {"vertex": [], "edge": []}, "added": {"vertex": [], "edge": []}, "key": None}

    def frontier(self) -> int:
        """Where a transaction starts: the last commit's time. All that is committed up to it is there, and what comes later has a later time."""
        return self.manifest()["tx_time"]

    def _history(self, kind: str, manifest: dict) -> DataFrame:
        schema = self.empty.schema_of(kind)
        paths = [f"{self.path}/{kind}/{b}" for b in manifest["batches"][kind]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def graph(self, manifest: dict | None = None) -> Graph:
        """What the last manifest holds, or the one given."""
        m = manifest or self.manifest()
        return Graph(self._history("vertex", m), self._history("edge", m), self.empty.vertex_properties, self.empty.edge_properties, m["log_index"], fixed_types=True)

    # -- writing

    def rows(self, kind: str, df: DataFrame) -> tuple[str, DataFrame]:
        """df with every column of the kind's history, those it lacks null; transaction columns come with the commit."""
        cols = []
        for f in self.empty.schema_of(kind):
            c = F.col(f.name) if f.name in df.columns else F.lit(False) if f.name == "tombstone" else F.lit(1) if f.name == "version" else F.lit(None)
            cols.append(c.cast(f.dataType).alias(f.name))
        return kind, df.select(*cols)

    @staticmethod
    def _key_file(key: str) -> str:
        return f"keys/{hashlib.sha256(key.encode()).hexdigest()}.json"

    def receipt(self, key: str, last: dict) -> dict | None:
        """What was committed under a key; the last manifest's key gets its file if that is missing."""
        if last["key"] is not None and not self.folder.exists(self._key_file(last["key"])):
            self.folder.publish(self._key_file(last["key"]), {"number": last["number"], "tx_time": last["tx_time"]})
        return self.folder.read(self._key_file(key)) if self.folder.exists(self._key_file(key)) else None

    def load(self, kind: str, rows: DataFrame) -> dict:
        """Commit rows that are known to be right, of any number, without the checks of a transaction."""
        return self.commit([self.rows(kind, rows)], limit=None, trusted=True)

    def commit(self, mutations: list[tuple[str, DataFrame]], start_tx: int | None = None, key: str | None = None, limit: int | None = MAX_MUTATIONS, trusted: bool = False, log_index: int | None = None) -> dict:
        """Check and commit; gives the receipt. A key that was committed before changes nothing. limit: mutations at most; trusted: unchecked; log_index: the place in the log that it must get."""
        m = self.manifest()
        known = self.receipt(key or "", m)
        if key is not None and known is not None:
            return known | {"replayed": True}
        if log_index not in (None, m["log_index"] + 1):
            raise TransactionError("CONFLICT", "another commit was first")
        g = self.graph(m)
        staged: dict[str, DataFrame] = {}
        for kind in ("vertex", "edge"):
            parts = [df for k, df in mutations if k == kind]
            if parts:
                df = parts[0]
                for p in parts[1:]:
                    df = df.unionByName(p)
                staged[kind] = materialize(df, "staged")
        sizes = {kind: df.count() for kind, df in staged.items()}
        if limit is not None and sum(sizes.values()) > limit:
            raise TransactionError("LIMIT", f"{sum(sizes.values())} mutations; at most {limit}")
        for kind, df in staged.items() if not trusted else ():
            if not df.where(~F.col("tombstone") & (F.col("valid_from") >= F.col("valid_to"))).isEmpty():
                raise TransactionError("INTERVAL", "a version that ends before it starts")
            if start_tx is not None and start_tx < m["tx_time"] and not conflicts(df, g.history(kind), start_tx).isEmpty():
                raise TransactionError("CONFLICT", "another commit was first")
        if not trusted and (fault := faults(staged, g).first()):
            raise TransactionError(fault["fault"], f"{fault['entity']} {fault['id']}")
        tx = max(time.time_ns() // 1000, m["tx_time"] + 1)
        log_index, name = m["log_index"] + 1, uuid.uuid4().hex
        batches = {k: list(v) for k, v in m["batches"].items()}
        added: dict[str, list[str]] = {"vertex": [], "edge": []}
        at = 0
        for kind, df in staged.items():
            rows = numbered(df.withColumns({"tx_time": F.lit(tx), "log_index": F.lit(log_index)}), [F.col("id"), F.col("version")], "ordinal", at)
            rows.select(*self.empty.schema_of(kind).names).write.parquet(f"{self.path}/{kind}/{name}")
            batches[kind].append(name)
            added[kind].append(name)
            at += sizes[kind]
        new = {"number": m["number"] + 1, "tx_time": tx, "log_index": log_index, "batches": batches, "added": added, "key": key}
        if not self.folder.publish(f"manifests/{new['number']:012d}.json", new):
            for kind in staged:
                self.folder.remove(f"{kind}/{name}")
            raise TransactionError("CONFLICT", "another commit was first")
        release(*staged.values())
        if key is not None:
            self.folder.publish(self._key_file(key), {"number": new["number"], "tx_time": tx})
        return {"number": new["number"], "tx_time": tx, "replayed": False}

    def compact(self) -> dict:
        """Rewrite all batches as one per kind, by ranges of identity, so that a point read skips row groups. Nothing that is read changes."""
        m, name = self.manifest(), uuid.uuid4().hex
        g = self.graph(m)
        batches: dict[str, list[str]] = {"vertex": [], "edge": []}
        for kind in batches:
            if m["batches"][kind]:
                g.history(kind).repartitionByRange("id").sortWithinPartitions("id", "tx_time", "version").write.parquet(f"{self.path}/{kind}/{name}")
                batches[kind] = [name]
        self.receipt("", m)
        new = m | {"number": m["number"] + 1, "batches": batches, "added": {"vertex": [], "edge": []}, "key": None}
        if not self.folder.publish(f"manifests/{new['number']:012d}.json", new):
            raise TransactionError("CONFLICT", "another commit was first")
        return new

    def restore(self, g: Graph) -> dict:
        """The first manifest of a new store: histories with the times and places in the log that they have already."""
        name, tops = uuid.uuid4().hex, []
        for kind in ("vertex", "edge"):
            rows = g.history(kind).select(*self.empty.schema_of(kind).names)
            rows.repartitionByRange("id").sortWithinPartitions("id", "tx_time", "version").write.parquet(f"{self.path}/{kind}/{name}")
            tops.append(self.spark.read.parquet(f"{self.path}/{kind}/{name}").agg(F.max("tx_time"), F.max("log_index")).first())
        top = [max((t[i] or 0 for t in tops), default=0) for i in (0, 1)]
        both = {"vertex": [name], "edge": [name]}
        new = self.nothing() | {"number": 1, "tx_time": top[0], "log_index": max(top[1], g.max_log_index or 0), "batches": both, "added": both}
        if not self.folder.publish(f"manifests/{1:012d}.json", new):
            raise TransactionError("CONFLICT", "the store is not new")
        return new

    def vacuum(self, through: int = 0, grace: float = 86_400.0) -> list[str]:
        """Remove batches that nothing reads: those of no manifest, left by writers that died, and those that only manifests up to a number name, which every feed has passed.

        Younger ones than grace seconds stay, as their commit may be under way, and so do those of open reads and of the last manifest.
        """
        numbers = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        kept = {n for n in numbers if int(n[:-5]) > through} | set(numbers[-1:])
        manifests = {n: self.folder.read(f"manifests/{n}") for n in numbers}
        pinned = [self.folder.read(f"reads/{n}")["number"] for n in self.folder.names("reads") if n.endswith(".json")]
        live = {k: {b for n, m in manifests.items() if n in kept or m["number"] in pinned for b in (*m["batches"][k], *m["added"][k])} for k in ("vertex", "edge")}
        gone = [f"{k}/{b}" for k in live for b, age in self.folder.ages(k).items() if b not in live[k] and age > grace]
        for name in gone:
            self.folder.remove(name)
        return gone

    # -- statements

    def mutations_of(self, program: ir.Program, params: dict, snapshot: Snapshot, request: str | None = None) -> list[tuple[str, DataFrame]]:
        """The rows that a CREATE, SET or DELETE statement stages."""
        m, g = program.mutation, self.graph()
        request = request or uuid.uuid4().hex
        at = params[m.valid_from.name] if isinstance(m.valid_from, ir.Parameter) else m.valid_from
        if isinstance(m, ir.CreateVertex):
            c = Compiler({}, params)
            one = self.spark.range(1).select(F.lit(request).alias("r"))
            props = {k: c(e).column for k, e in m.properties}
            row = one.select((F.pmod(F.xxhash64("r"), F.lit(1 << 62)) + 1).alias("id"), F.lit(at).alias("valid_from"), F.lit(OPEN).alias("valid_to"), F.array(*map(F.lit, m.labels)).cast("array<string>").alias("labels"), *[v.alias(k) for k, v in self._declared("vertex", props).items()])
            return [self.rows("vertex", row)]
        needed = required_columns((program.plan, m))
        low = Lowering(g, snapshot, params, needed)
        df = low.lower(program.plan)
        known = {v: Typed(F.col(f"`{v}`"), low.tags[v], low.variables[v]) for v in low.variables if v in df.columns}
        c = Compiler(known, params)
        if isinstance(m, ir.CreateRelationship):
            props = self._declared("edge", {k: c(e).column for k, e in m.properties})
            ends = df.select(F.col(f"`{m.source}`.`$id`").alias("src"), F.col(f"`{m.destination}`.`$id`").alias("dst"), *[v.alias(k) for k, v in props.items()])
            ends = numbered(ends, [F.col("src"), F.col("dst")], "n")
            row = ends.withColumn("id", F.pmod(F.xxhash64(F.lit(request), "src", "dst", "n"), F.lit(1 << 62)) + 1).withColumns({"valid_from": F.lit(at), "valid_to": F.lit(OPEN), "edge_type": F.lit(m.type)})
            return [self.rows("edge", row.drop("n"))]
        kind = "vertex" if low.tags[m.variable] == "vertex" else "edge"
        ids = df.select(F.col(f"`{m.variable}`.`$id`").alias("id"), *([v.alias(f"@{k}") for k, v in self._declared(kind, {k: c(e).column for k, e in m.properties}).items()] if isinstance(m, ir.SetProperties) else [])).dropDuplicates(["id"])
        history = g.history(kind)
        last = history.join(ids.select("id"), "id", "left_semi").groupBy("id").agg((F.max("version") + 1).alias("version"))
        fixed = ["labels"] if kind == "vertex" else ["src", "dst", "edge_type"]
        if isinstance(m, ir.Delete):
            if kind == "edge":  # a delete names the ends that it frees
                last = last.join(history.where(~F.col("tombstone")).groupBy("id").agg(F.max_by(F.struct(*fixed), F.struct("tx_time", "version")).alias("e")), "id").select("id", "version", "e.*")
            return [self.rows(kind, last.withColumn("tombstone", F.lit(True)))]
        names = [p.name for p in self.empty.properties(kind)]
        old = temporal.visible(history, snapshot.valid_at, snapshot.tx_at, [*fixed, *names])
        new = old.join(ids, "id").join(last, "id").withColumns({"valid_from": F.lit(at), "valid_to": F.lit(OPEN)})
        for k, _ in m.properties:
            new = new.withColumn(k, F.col(f"`@{k}`"))
        return [self.rows(kind, new)]

    def _declared(self, kind: str, props: dict) -> dict:
        names = {p.name for p in self.empty.properties(kind)}
        if missing := sorted(set(props) - names):
            raise TransactionError("PROPERTY", "not declared: " + ", ".join(missing))
        return props
