"""A store behind the operations of a storage provider: handshake, apply, pinned reads, snapshots and health.

The store is GraphWriter's. Batches are applied in the order of a log whose indexes have no gaps, each command
once: a command that was applied changes nothing when it comes again, and one that comes again with other
content is refused. A read is pinned to one manifest, so commits, compaction and vacuum do not change what it sees.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tempora.model import Graph, PropertySpec
from tempora.operators import temporal
from tempora.operators.write import GraphWriter, TransactionError
from tempora.sources import store

VERSION = 1
CAPABILITIES = ("apply", "pinned-reads", "filters", "snapshots", "change-log")


class ProviderError(ValueError):
    """code: VERSION, GAP, REUSED, NO-READ or DIFFERS."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Provider:
    def __init__(self, spark: SparkSession, path: str, vertex_properties: list[PropertySpec], edge_properties: list[PropertySpec]):
        self.spark, self.path = spark, path.rstrip("/")
        self.properties = (vertex_properties, edge_properties)
        self.writer = GraphWriter(spark, path, *self.properties)
        self.folder = self.writer.folder

    def handshake(self, version: int) -> dict:
        """What is spoken here, and how far the log goes."""
        if version != VERSION:
            raise ProviderError("VERSION", f"version {version}; {VERSION} is spoken here")
        m = self.writer.manifest()
        return {"version": VERSION, "capabilities": list(CAPABILITIES), "log_index": m["log_index"], "tx_time": m["tx_time"]}

    def health(self) -> dict:
        """Whether all batches of the last manifest are there."""
        m = self.writer.manifest()
        missing = [f"{k}/{b}" for k, names in m["batches"].items() for b in names if not self.folder.exists(f"{k}/{b}/_SUCCESS")]
        return {"ok": not missing, "missing": missing, "log_index": m["log_index"], "reads": len([n for n in self.folder.names("reads") if n.endswith(".json")])}

    # -- the log

    def apply(self, log_index: int, command: str, mutations: list[tuple[str, DataFrame]]) -> dict:
        """Apply a batch (kinds with their rows) as the log's next entry; the receipt of its commit."""
        content = [(kind, store.digest(df)) for kind, df in (self.writer.rows(k, df) for k, df in mutations)]
        claim = {"content": hashlib.sha256(repr(content).encode()).hexdigest()}
        name = f"commands/{hashlib.sha256(command.encode()).hexdigest()}.json"
        if not self.folder.publish(name, claim) and self.folder.read(name) != claim:
            raise ProviderError("REUSED", f"the command {command!r} was another batch")
        last = self.writer.manifest()
        if self.writer.receipt(command, last) is None and log_index != last["log_index"] + 1:
            raise ProviderError("GAP", f"log index {log_index} after {last['log_index']}")
        return self.writer.commit([self.writer.rows(k, df) for k, df in mutations], key=command, log_index=log_index)

    # -- reads

    def begin_read(self) -> str:
        """Pin what is there now; give the read's name."""
        while True:
            name, number = uuid.uuid4().hex, self.writer.manifest()["number"]
            self.folder.publish(f"reads/{name}.json", {"number": number, "at": time.time()})
            if self.writer.manifest()["number"] == number:  # else a vacuum may have passed it unseen
                return name
            self.end_read(name)

    def _pinned(self, read: str) -> Graph:
        if not self.folder.exists(f"reads/{read}.json"):
            raise ProviderError("NO-READ", f"no read {read!r} is open")
        number = self.folder.read(f"reads/{read}.json")["number"]
        return self.writer.graph(self.folder.read(f"manifests/{number:012d}.json")) if number else self.writer.graph(self.writer.nothing())

    def read(self, read: str, kind: str, valid_at: int | None = None, tx_at: int | None = None) -> DataFrame:
        """The history of one kind ("vertex", "edge") as it was when the read began, or with both instants what is visible then; filters on it reach the files."""
        g = self._pinned(read)
        if valid_at is None or tx_at is None:
            return g.history(kind)
        fixed = ["labels"] if kind == "vertex" else ["src", "dst", "edge_type"]
        return temporal.visible(g.history(kind), valid_at, tx_at, [*fixed, *(p.name for p in g.properties(kind))])

    def changes(self, read: str, after: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
        g = self._pinned(read)
        return temporal.changes(temporal.change_log(g.vertices, g.edges), after, g.max_log_index or 0, limit)

    def end_read(self, read: str) -> None:
        self.folder.remove(f"reads/{read}.json")

    # -- snapshots

    def export_snapshot(self, path: str, through: int | None = None) -> dict:
        m = self.writer.manifest()
        return store.export_snapshot(self.writer.graph(m), path, m["log_index"] if through is None else through)

    def import_snapshot(self, path: str, target: str) -> Provider:
        """A store at target, which must be new, with a snapshot's content and its place in the log."""
        g = store.import_snapshot(self.spark, path, *self.properties)
        out = Provider(self.spark, target, *self.properties)
        if out.writer.manifest()["number"]:
            raise ProviderError("DIFFERS", "the target holds a store already")
        out.writer.restore(g)
        return out

    def activate(self, staged: Provider) -> None:
        """Put an imported store in this one's place; what was here is moved aside."""
        if not staged.health()["ok"]:
            raise ProviderError("DIFFERS", "the imported store is not whole")
        store.replace(self.spark, staged.path, self.path)


__all__ = ["CAPABILITIES", "Provider", "ProviderError", "TransactionError", "VERSION"]
