"""Written intermediates: a loop's state goes to the shared folder, which survives lost executors.

What a loop has written anew it releases, so that a loop of any length keeps a few rounds of its state.
All that is left goes when the driver's process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folders that were written and not yet released, with the session that wrote them.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset and Spark runs in one process."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    d = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(d, exist_ok=True)
    return f"file://{d}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed like a written intermediate."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    return path


def release(*frames: DataFrame | None) -> None:
    """Remove the files of frames that materialize() gave and that nothing will read again."""
    for f in frames:
        path = getattr(f, "written_path", None)
        if path in _written:
            _remove(path, _written.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc.sc().isStopped() else spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for path, spark in _written.items():
        try:
            _remove(path, spark)
        except Exception:  # the JVM may be gone before this process; what it shared stays for its owner to clear
            return


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with name, the place of each row in the global order; sorted by ranges, so no task holds all rows."""
    spark = df.sparkSession
    marked = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_m", 33)
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row per task
    offsets, at = [], start
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    if not offsets:
        return marked.withColumn(name, F.lit(0).cast("bigint")).drop("_m")
    base = spark.createDataFrame(offsets, "_p bigint, _o bigint")
    return marked.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_o", "_m")
