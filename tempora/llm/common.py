"""What the operators share: inputs, the shared folder, written intermediates, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tempora.functions.lineage import materialize as materialize

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    if not (root / "tempora").is_dir():  # already running from a shipped archive
        return
    fd, path = tempfile.mkstemp(prefix="tempora-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "tempora").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that none of their names can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def schema_with(df: DataFrame, names: list[str], more: str = "") -> T.StructType:
    """The schema of some columns of df and of more, given as DDL."""
    return T.StructType([*(df.schema[n] for n in names), *(T.StructType.fromDDL(more).fields if more else [])])


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


#: Resolution of sampling fractions.
GRAIN = 1 << 30


def sampled(key: Column, classes: Column, counts: dict, bound: int, salt: int = 0) -> Column:
    """A condition that keeps about bound rows of each class: all if it has fewer, else those with a low hash of their key."""
    cut = None
    for value, n in sorted(counts.items(), key=str):
        limit = GRAIN if n <= bound else max(1, GRAIN * bound // n)
        c = (classes == F.lit(value)) & (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(GRAIN)) < limit)
        cut = c if cut is None else cut | c
    return F.lit(False) if cut is None else cut


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, for tables with very long texts, where this Spark can."""
    ship(spark)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # an older Spark has only the bound on rows
        if "maxBytesPerBatch" not in str(e):
            raise
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


class Bounded:
    """A function over batches that gives free memory back to the system after each one; Spark's workers live on between tasks."""

    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in self.function(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            if _trim is not None:
                _trim(0)
