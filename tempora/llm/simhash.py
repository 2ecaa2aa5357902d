"""SimHash near-duplicate groups by segment counts, a grid join and an exact check.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Held in
thermometer code, the Manhattan distance of two embeddings is the number of differing
bits of their codes, and never more than the Hamming distance of the fingerprints. Two
embeddings at Manhattan distance 3 or less differ in at most 3 of 6 bands of segments,
so they share the grid cell of at least one of the 20 choices of 3 bands: a range join
is a join on equal cells. Survivors of the lower bound are verified on all 64 bits.

Only distinct fingerprints are joined. A cell above CELL_ROWS members is not compared as it is:
the fingerprints of such cells are joined once more by one-bit segments, whose Manhattan distance is
the Hamming distance itself, on cells of 40 exact bits (5 of 8 bands). So the comparisons that a
fingerprint takes part in are bounded however many there are, but where thousands of distinct ones
share those 40 bits; such a cell is cut in chunks, and each pair of chunks is compared in a block
of its own, so no task holds an unbounded group. A block emits a spanning forest of its links,
never the pairs. Connected components are found by alternating stars over written tables. The
fingerprint of a text that stands in more than HOT_ROWS rows is joined to them by broadcast.

Null or empty text: fingerprint zero, which links like any other. Fewer than three words:
one shingle of the whole sequence. Very long texts: hashed whole, a slice of shingles at a time.
Repeated rows and repeated ids stay separate rows. Null ids: kept, and never a component's least id
unless it has no other (then null). Ties: a bit set in exactly half the shingles is 0. Empty table:
no rows. Extra columns, whatever their names, are not read; one_of_each keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tempora.functions.components import components
from tempora.llm.common import Bounded, documents, materialize, small_batches, whole

MAX_BITS = 3
SEED = 42
#: Bands of two-bit segments: at most MAX_BITS of them can differ.
BAND_SEGMENTS = (5, 5, 5, 5, 6, 6)
#: Bands of single bits for the fingerprints of crowded cells.
BAND_BITS = (8,) * 8
#: Members of a cell that one block compares.
CELL_ROWS = 1024
#: Crowded cells to broadcast at most; more are joined by a shuffle.
HOT_CELLS = 65_536
#: Rows of one fingerprint above which it is broadcast: with n rows, fewer than n / HOT_ROWS are.
HOT_ROWS = 1 << 20
#: Rows that links are looked for in at a time.
STEP = 1 << 16

EVEN = 0x5555555555555555
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def band_masks(widths: tuple[int, ...] = BAND_SEGMENTS, segment: int = 2) -> list[int]:
    """The bits of each choice of bands that MAX_BITS differences must leave alone."""
    bands, at = [], 0
    for n in widths:
        bands.append(((1 << segment * n) - 1) << at)
        at += segment * n
    return [_signed(sum(some)) for some in combinations(bands, len(bands) - MAX_BITS)]


# ---- fingerprints

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _shingle_hashes(text: bytes | None) -> list[int]:
    w = text.lower().split() if text else []
    if not w:
        return []
    if len(w) < 3:
        return [_hash(b" ".join(w))]
    return list(map(_hash, map(b" ".join, zip(w, w[1:], w[2:]))))


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Signed 64-bit fingerprints. Bits are counted in byte lanes, 255 shingles at a time."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not owners:
            return
        sizes = np.array([len(h) for h in hashes])
        h = np.concatenate(hashes)
        blocks = -(-sizes // 255)
        first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        block_in_doc = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
        starts = np.repeat(doc_start, blocks) + 255 * block_in_doc
        lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
        per_block = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(per_block, first_block, axis=0, dtype=np.int64)
        bits = (2 * ones > sizes[:, None]).astype(np.uint8)
        out[np.array(owners)] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if h := _shingle_hashes(text):
            hashes.append(np.array(h, dtype=np.uint64))
            owners.append(i)
            held += len(h)
            if held > 200_000:
                flush()
    flush()
    return out.view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.schema.get_field_index("_text")).to_pylist()
        keep = [n for n in b.schema.names if n != "_text"]
        cols = [b.column(b.schema.get_field_index(n)) for n in keep]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(fingerprints(texts), pa.int64())], names=[*keep, "fp"])


def with_fingerprint(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns keep and fp, the fingerprint of the text."""
    small_batches(df.sparkSession)
    df = df.select(*keep, F.col(text).cast("binary").alias("_text"))
    return df.mapInArrow(Bounded(_fingerprint_batches), ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "_text") + ", fp bigint")


# ---- links

def embedding(fp: Column) -> Column:
    """Thermometer code of the two-bit segments' counts."""
    even = F.lit(EVEN)
    odd = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(odd).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(odd).bitwiseAND(even), 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    odd, even = fp >> np.uint64(1), np.uint64(EVEN)
    return ((fp | odd) & even) | (((fp & odd) & even) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices at Manhattan distance within the bound whose Hamming distance is so too."""
    at = np.nonzero(np.bitwise_count(ea ^ eb) <= MAX_BITS)
    full = np.broadcast_arrays(a, b)
    ok = np.bitwise_count(full[0][at] ^ full[1][at]) <= MAX_BITS
    return tuple(x[ok] for x in at)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of each link the least label of their classes."""
    while True:
        li, lj = label[i], label[j]
        if (differ := li != lj).any():
            m = np.minimum(li, lj)[differ]
            np.minimum.at(label, li[differ], m)
            np.minimum.at(label, lj[differ], m)
            while (jump := label[label]).tobytes() != label.tobytes():
                label[:] = jump
        else:
            return


def _forest(run: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal runs as a spanning forest, (greater fp, less fp) of signed order."""
    n = len(fp)
    label = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    length = np.diff(np.append(start, n))
    emb = _embed(fp)
    small = np.repeat(length <= 48, length)
    longest = int(length[length <= 48].max(initial=0))
    for k in range(1, longest):
        at = np.flatnonzero((run[:-k] == run[k:]) & small[k:])
        if not len(at):
            break
        (ok,) = _near(fp[at], fp[at + k], emb[at], emb[at + k])
        _unite(label, at[ok], at[ok] + k)
    for s, m in zip(start[length > 48], length[length > 48]):
        for lo in range(s, s + m, 256):
            hi = min(lo + 256, s + m)
            i, j = _near(fp[lo:hi, None], fp[None, lo : s + m], emb[lo:hi, None], emb[None, lo : s + m])
            _unite(label, lo + i, lo + j)
    child = np.flatnonzero(label != np.arange(n))
    a, b = fp.view(np.int64)[child], fp.view(np.int64)[label[child]]
    return np.maximum(a, b), np.minimum(a, b)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and block; the last run of a batch waits for the next."""
    def emit(cell: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate([[0], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])]).astype(np.int64)
        u, v = _forest(np.cumsum(change), fp)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held.append([*new[:2], new[2].view(np.uint64)])
        size += b.num_rows
        if size < STEP:
            continue
        cell, block, fp = joined()
        last = np.flatnonzero((cell != cell[-1]) | (block != block[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield emit(cell[:cut], block[:cut], fp[:cut])
        held[:] = [[cell[cut:], block[cut:], fp[cut:]]]
        size = len(cell) - cut
    if size:
        yield emit(*joined())


def _cells(fps: DataFrame, code: Column, masks: list[int]) -> DataFrame:
    """fp and cell: one row for each choice of bands."""
    return fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), code.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("cell"))


def _crowded(cells: DataFrame) -> DataFrame | None:
    """cell and n of those above CELL_ROWS, to be broadcast where they are few; None if there are none."""
    hot = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "simhash-hot")
    n = hot.limit(HOT_CELLS + 1).count()
    return (F.broadcast(hot) if n <= HOT_CELLS else hot) if n else None


def _compared(cells: DataFrame) -> DataFrame:
    """u > v: links within equal cell and block."""
    small_batches(cells.sparkSession)
    return cells.select("cell", "block", "fp").repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(Bounded(_link_batches), "u bigint, v bigint")


def links(fps: DataFrame) -> DataFrame:
    """Columns u > v: links that join all distinct fingerprints (column fp) within MAX_BITS, as forests of cells."""
    one = F.lit(0).cast("bigint")
    cells = _cells(fps, embedding(F.col("fp")), band_masks())
    hot = _crowded(cells)
    if hot is None:
        return _compared(cells.withColumn("block", one)).distinct()
    found = _compared(cells.join(hot, "cell", "left_anti").withColumn("block", one))
    crowd = materialize(cells.join(hot, "cell", "left_semi").select("fp").distinct(), "simhash-crowd")
    cells = _cells(crowd, F.col("fp"), band_masks(BAND_BITS, 1))
    hot = _crowded(cells)
    if hot is None:
        cells = cells.withColumn("block", one)
    else:
        parts = F.coalesce(F.ceil(F.col("n") / (CELL_ROWS / 2)), F.lit(1)).cast("bigint")
        cells = cells.join(hot, "cell", "left").withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("fp"), "parts"))
        blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("chunk", j) * F.col("parts") + F.greatest("chunk", j))
        cells = cells.select("cell", F.explode(blocks).cast("bigint").alias("block"), "fp")
    return found.unionByName(_compared(cells)).distinct()


# ---- groups

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp, text_hash and component_id, the least id of the fingerprint's component."""
    rows = materialize(with_fingerprint(docs, text_col, [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-fps")
    stars = components(links(fps.select("fp")))
    labels = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = labels.join(fps, "fp")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = materialize(fps.join(labels, "fp", "left").join(roots, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "simhash-groups")
    hot = of_fp.where(F.col("n") > HOT_ROWS).select("fp", "component_id", F.lit(True).alias("hot"))
    if hot.isEmpty():
        return rows.join(of_fp.drop("n"), "fp")
    marked = rows.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot is null").select(*rows.columns).join(of_fp.drop("n"), "fp")
    return marked.where("hot").select(*rest.columns).unionByName(rest)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of least id of each near-duplicate group; of rows equal in id and text, one."""
    near = near_duplicates(docs)
    keep = near.groupBy(F.coalesce("component_id", "fp").alias("c")).agg(F.min(F.struct("id", "text_hash")).alias("k"), F.count("*").alias("n"))
    keep = materialize(keep.select("k.id", "k.text_hash"), "simhash-keep")
    d, k = docs.alias("d"), keep.alias("k")
    kept = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.id")) & (F.xxhash64("d.text") == F.col("k.text_hash")), "left_semi")
    again = near.join(keep, near["id"].eqNullSafe(keep["id"]) & (near["text_hash"] == keep["text_hash"]), "left_semi").groupBy("id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return kept
    return kept.select(whole(docs), "doc_id", F.xxhash64("text").alias("h")).dropDuplicates(["doc_id", "h"]).select("doc.*")
