"""Snapshot export and import with a manifest, relational sources, and a Python data source over a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tempora.model import Graph, PropertySpec
from tempora.sources.files import Folder


def digest(df: DataFrame) -> dict:
    """Row count and an order-free content digest, computed where the rows are."""
    c = [F.to_json(F.col(x)) if df.schema[x].dataType.typeName() in ("array", "struct", "map") else F.col(x) for x in sorted(df.columns)]
    h = F.xxhash64(*c)
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2_147_483_647))).alias("a"), F.bit_xor(h).alias("b")).first()
    return {"rows": r["n"], "sum": r["a"] or 0, "xor": r["b"] or 0}


def export_snapshot(graph: Graph, path: str, through: int | None = None) -> dict:
    """Write both histories up to a log index, and a manifest with their digests."""
    spark = graph.vertices.sparkSession
    out = {"format": 1, "through": through, "parts": {}}
    for kind in ("vertex", "edge"):
        df = graph.history(kind)
        df = df if through is None else df.where(F.col("log_index") <= through)
        df.write.parquet(f"{path}/{kind}")
        out["parts"][kind] = digest(spark.read.parquet(f"{path}/{kind}"))
    if not Folder(spark, path).publish("manifest.json", out):
        raise ValueError("the snapshot is there already")
    return out


def import_snapshot(spark: SparkSession, path: str, vertex_properties: list[PropertySpec], edge_properties: list[PropertySpec]) -> Graph:
    """Read a snapshot, after its manifest has been compared with what is there."""
    manifest = Folder(spark, path).read("manifest.json")
    g = Graph(None, None, vertex_properties, edge_properties, manifest["through"])
    parts = {}
    for kind in ("vertex", "edge"):
        parts[kind] = spark.read.schema(g.schema_of(kind)).parquet(f"{path}/{kind}")
        if digest(parts[kind]) != manifest["parts"][kind]:
            raise ValueError(f"the {kind} part differs from its manifest")
    return Graph(parts["vertex"], parts["edge"], vertex_properties, edge_properties, manifest["through"])


def activate(spark: SparkSession, path: str, target: str) -> None:
    """Put a snapshot with a manifest in the place of target, whose content is moved aside first."""
    if not Folder(spark, path).exists("manifest.json"):
        raise ValueError("no manifest")
    replace(spark, path, target)


def replace(spark: SparkSession, path: str, target: str) -> None:
    """Move one folder to the place of another, which is moved aside and comes back if that fails."""
    parent, _, name = target.rstrip("/").rpartition("/")
    holder, _, leaf = path.rstrip("/").rpartition("/")
    if not Folder(spark, holder).exists(leaf):
        raise ValueError("there is nothing to move")
    old, aside = Folder(spark, parent), f"{name}.before-{uuid.uuid4().hex}"
    moved = old.exists(name) and old.rename(name, f"{parent}/{aside}")
    if not Folder(spark, holder).rename(leaf, target):
        if moved:
            old.rename(aside, target)
        raise ValueError("the folder could not be moved")


def jdbc_history(spark: SparkSession, url: str, table: str, options: dict | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A history table of a relational database; bounds (lower, upper, partitions) split the read by id."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if bounds:
        r = r.option("partitionColumn", "id").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2])
    return r.load()


class StoreSource(DataSource):
    """spark.read.format("tempora"): a third-party store, here one that serves Parquet files by part, and takes them.

    Options: paths, a comma-separated list of files that every executor can open, or path, a folder of them.
    With option filters=true the store answers filters on integers, strings and booleans, and Spark applies all
    others to what it gets; that needs spark.sql.python.filterPushdown.enabled, without which Spark refuses such a
    reader. A write leaves its parts under names that no reader sees until all tasks are done. Subclass and
    override reader() or writer() to serve another store.
    """

    @classmethod
    def name(cls) -> str:
        return "tempora"

    def _paths(self) -> list[str]:
        if "path" in self.options:
            fs, at = _file_system(self.options["path"])
            from pyarrow.fs import FileSelector

            return sorted(f"{self.options['path'].rstrip('/')}/{f.base_name}" for f in fs.get_file_info(FileSelector(at)) if f.is_file and f.base_name[0] not in "_.")
        return [p for p in self.options.get("paths", "").split(",") if p]

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, at = _file_system(self._paths()[0])
        return from_arrow_schema(pq.read_schema(at, filesystem=fs))

    def reader(self, schema):
        kind = _FilteringReader if self.options.get("filters", "false").lower() == "true" else _StoreReader
        return kind(self._paths(), schema.names)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("this store is only added to")
        return _StoreWriter(self.options["path"].rstrip("/"))


def _file_system(path: str):
    """pyarrow's file system for a path or URL, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if ":" in path.split("/")[0] else (LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _StoreReader(DataSourceReader):
    """wanted: the filters that read() applies, as (kind of filter, column, value)."""

    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns
        self.wanted: list[tuple[str, str, object]] = []

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        import pyarrow.dataset as ds

        fs, at = _file_system(partition.path)
        keep = None
        for kind, column, value in self.wanted:
            c = ds.field(column)
            one = c.is_null() if kind == "IsNull" else c.is_valid() if kind == "IsNotNull" else c.isin(list(value)) if kind == "In" else getattr(c, _COMPARE[kind])(value)
            keep = one if keep is None else keep & one
        yield from ds.dataset(at, format="parquet", filesystem=fs).to_batches(columns=self.columns, filter=keep)


_COMPARE = {"EqualTo": "__eq__", "GreaterThan": "__gt__", "GreaterThanOrEqual": "__ge__", "LessThan": "__lt__", "LessThanOrEqual": "__le__", "In": "isin"}


class _FilteringReader(_StoreReader):
    def pushFilters(self, filters):
        for f in filters:
            kind, value = type(f).__name__, getattr(f, "value", None)
            exact = len(f.attribute) == 1 if hasattr(f, "attribute") else False
            if exact and (kind in ("IsNull", "IsNotNull") or (kind in _COMPARE and all(isinstance(v, (bool, int, str)) for v in (value if kind == "In" else (value,))))):
                self.wanted.append((kind, f.attribute[0], value))
            else:
                yield f


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _StoreWriter(DataSourceArrowWriter):
    """Each task writes one part under a hidden name; the driver names them all once every task is done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        import pyarrow.parquet as pq

        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        name, out = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            out = out or pq.ParquetWriter(f"{at}/_{name}", batch.schema, filesystem=fs)
            out.write_batch(batch)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def _each(self, messages):
        fs, at = _file_system(self.path)
        return ((fs, f"{at}/_{m.name}", f"{at}/part-{m.name}") for m in messages if m is not None and m.name)

    def commit(self, messages):
        for fs, hidden, name in self._each(messages):
            fs.move(hidden, name)

    def abort(self, messages):
        for fs, hidden, _ in self._each(messages):
            fs.delete_file(hidden)
