"""Sequence packing: first-fit decreasing on a tournament tree of bins, in randomised groups.

Each whole text becomes its ids and END, cut in pieces of at most CAPACITY ids; every id lies in
one piece. Pieces are dealt at random, by a hash of id, place and row, to as many groups as give
each about GROUP pieces. A group is packed alone: its pieces, longest first, each go to the first
bin with room, found in a tree whose nodes hold the most room below them, in logarithmic time.

A group leaves few bins part full, about one sequence of padding in thousands of pieces, so no
piece is cut a second time to fill gaps.

Null or empty text: END alone. Very long texts are cut in as many pieces as they need. Repeated rows
and ids are packed as often as they stand. Ties: of pieces of equal length the one of lesser hash goes
first. Empty table: no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tempora.llm.bpe import encoder, tokenizer_path
from tempora.llm.common import Bounded, documents, materialize, small_batches

CAPACITY = 4096
END = 2
#: Pieces of a group, about.
GROUP = 8192
SEED = 29


class _Pieces:
    """doc_id and text in; pieces out, with a row number that tells equal rows of a task apart."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(self.path), 0
        for b in batches:
            source: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            total: list[int] = []
            for i, ids in enumerate(e.encode(b.column(1).to_pylist())):
                data = np.append(ids, END).astype("<u4").tobytes()
                n = len(data) // 4
                for at in range(0, n, CAPACITY):
                    part = data[4 * at : 4 * (at + CAPACITY)]
                    source.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            ints = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ints(source)), ints(start), ints(length), ints(crc), ints(total), ints([row + i for i in source])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
            row += b.num_rows


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each size, in the order given; sizes are taken longest first, equal ones in order."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        s, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < s:
                node += 1
        bins[i] = node - leaves
        room[node] -= s
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _pack(group: pa.Table) -> pa.Table:
    order = np.lexsort([group.column(c).to_numpy() for c in ("row", "ids_crc32", "start", "mix")])
    group = group.take(pa.array(order))
    size = group.column("length").to_numpy()
    bins = np.array(first_fit_decreasing(size.tolist()), dtype=np.int64)
    place = np.lexsort([np.arange(len(size)), -size, bins])
    end = np.cumsum(size[place])
    begins = np.concatenate([[True], bins[place][1:] != bins[place][:-1]])
    base = np.maximum.accumulate(np.where(begins, end - size[place], 0))
    offset = np.empty(len(size), dtype=np.int64)
    offset[place] = end - size[place] - base
    sequence = (group.column("group").to_numpy() << 24) | bins
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return pa.table([*(group.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and the place in it."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    pieces = docs.select("doc_id", "text").mapInArrow(Bounded(_Pieces(path or tokenizer_path("word_bpe_49k.json"))), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row bigint")
    pieces = materialize(pieces, "packing-pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    mix = F.xxhash64("doc_id", "start", "ids_crc32", "row", F.lit(SEED))
    dealt = pieces.withColumn("mix", mix).withColumn("group", F.pmod("mix", F.lit(groups)).cast("bigint"))
    return dealt.groupBy("group").applyInArrow(_pack, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
