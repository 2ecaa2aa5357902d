"""Streaming writes with receipts, and the change feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tempora.functions.lineage import materialize, release
from tempora.model import OPEN
from tempora.operators import temporal
from tempora.operators.write import GraphWriter, TransactionError
from tempora.sources.files import Folder

#: Folders that receipts are dealt to by the hash of their key, so that a batch meets those of its keys only.
BUCKETS = 16


class Ingest:
    """Vertices from a stream (item_key, id, valid_from and properties) into a GraphWriter, each key once.

    A batch is one commit under its batch id, so a batch that is tried again changes nothing. Every
    item gets a receipt: COMMITTED, or REJECTED where its key was taken with other content. Items
    with the same key and content as a committed one count as committed then.
    """

    RECEIPT = "item_key string, digest bigint, status string, tx_time bigint, batch_id bigint, bucket int"

    def __init__(self, writer: GraphWriter, receipts: str):
        self.writer, self.path = writer, receipts.rstrip("/")
        self.spark: SparkSession = writer.spark
        self.folder = Folder(self.spark, receipts)

    def _receipts(self) -> DataFrame:
        schema = StructType.fromDDL(self.RECEIPT)
        return self.spark.read.schema(schema).parquet(self.path) if any(n.startswith("batch_id=") for n in self.folder.names()) else self.spark.createDataFrame([], schema)

    def receipts(self) -> DataFrame:
        return self._receipts().drop("bucket")

    def batch(self, items: DataFrame, batch_id: int) -> None:
        payload = F.xxhash64(*[F.col(c) for c in sorted(items.columns) if c != "item_key"])
        bucket = F.pmod(F.xxhash64("item_key"), F.lit(BUCKETS)).cast("int")
        items = materialize(items.withColumn("digest", payload).withColumn("bucket", bucket), "ingest")
        known = self._receipts().where((F.col("status") == "COMMITTED") & (F.col("batch_id") != batch_id)).select("bucket", "item_key", F.col("digest").alias("had"))
        buckets = [r["bucket"] for r in items.select("bucket").distinct().collect()]  # BUCKETS at most
        known = known.where(F.col("bucket").isin(buckets)).distinct()
        first = items.groupBy("item_key").agg(F.min("digest").alias("first"))
        judged = items.join(first, "item_key").join(known, ["bucket", "item_key"], "left")
        fresh = materialize(judged.where(F.col("had").isNull() & (F.col("digest") == F.col("first"))).dropDuplicates(["item_key"]).drop("first", "had", "bucket"), "ingest")
        tx = 0
        if not fresh.isEmpty():  # the versions of identities that are there go on from their last
            last = self.writer.graph().vertices.join(fresh.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("version").alias("last"))
            rows = fresh.join(last, "id", "left").withColumns({"version": F.coalesce("last", F.lit(0)) + 1, "valid_to": F.lit(OPEN)})
            tx = self.writer.commit([self.writer.rows("vertex", rows)], key=f"{self.path}#{batch_id}", limit=None)["tx_time"]
        ok = F.coalesce(F.col("had"), F.col("first")) == F.col("digest")
        out = judged.select("item_key", "digest", F.when(ok, "COMMITTED").otherwise("REJECTED").alias("status"), F.lit(tx).cast("bigint").alias("tx_time"), "bucket").distinct()
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch_id={batch_id}")
        release(items, fresh)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run a streaming frame through batch()."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_MANIFEST = "number bigint, log_index bigint, added struct<vertex:array<string>,edge:array<string>>"


def _rows_of_folders(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths of Parquet folders in, their rows out; a function of its own, as workers need not have this module."""
    def rows(batches):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path) if "://" in path else (None, path)
                for part in ds.dataset(at, schema=schema, filesystem=fs, format="parquet").to_batches(columns=schema.names):
                    yield part.cast(schema)

    return rows


class ChangeFeed:
    """The committed log of a store, record by record in log order, each once; compaction and commits that lost add nothing.

    A cursor is a (log index, ordinal) pair; what follows it is read with changes(), a page at a time. start() runs
    a function over the records of each commit as commits come, and stream() gives them as a streaming frame.
    """

    def __init__(self, writer: GraphWriter):
        self.writer, self.spark = writer, writer.spark

    def changes(self, after: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
        g = self.writer.graph()
        return temporal.changes(temporal.change_log(g.vertices, g.edges), after, g.max_log_index or 0, limit)

    def _manifests(self) -> DataFrame:
        return self.spark.readStream.schema(_MANIFEST).option("pathGlobFilter", "*.json").json(f"{self.writer.path}/manifests")

    def start(self, function: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
        """Call function with the log records of each batch of new manifests and the batch's number."""
        def run(manifests: DataFrame, batch: int) -> None:
            found = manifests.where(F.size("added.vertex") + F.size("added.edge") > 0).select("added").collect()  # a row per commit
            parts = {k: [f"{self.writer.path}/{k}/{b}" for r in found for b in r["added"][k]] for k in ("vertex", "edge")}
            read = lambda k: self.spark.read.schema(self.writer.empty.schema_of(k)).parquet(*parts[k]) if parts[k] else self.spark.createDataFrame([], self.writer.empty.schema_of(k))
            if found:
                function(temporal.change_log(read("vertex"), read("edge")), batch)

        return self._manifests().writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def stream(self, kind: str) -> DataFrame:
        """The rows of one kind's history as they are committed, as a streaming frame. The executors read the batches through pyarrow's file systems."""
        files = self._manifests().select(F.explode(f"added.{kind}").alias("batch")).select(F.concat(F.lit(f"{self.writer.path}/{kind}/"), "batch").alias("path"))
        schema = self.writer.empty.schema_of(kind)
        return files.mapInArrow(_rows_of_folders(to_arrow_schema(schema)), schema)


__all__ = ["ChangeFeed", "Ingest", "TransactionError"]
