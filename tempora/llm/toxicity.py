"""Toxicity by a factorization machine over hashed terms, with calibrated scores.

Terms are the lower-cased runs of word characters of the whole text, each once, hashed to
BUCKETS columns. The machine scores bias + sum of weights + sum over pairs of terms of the
inner product of their RANK factors, so a pair such as an insult with a group mention can count
where neither does alone. Columns met in fewer than MIN_DOCS training documents stay at zero. Labels
are noisy, and thousands of terms would learn the noise: columns whose share differs between the
labels by less than MIN_Z standard errors are held to HELD times the L2 shrinkage, so they count by
what pairs or many documents bear out.
Adagrad fits it on the logistic loss with that shrinkage; a logistic line fitted on rows kept
aside, weighted back to the labels' true shares, turns its output into a probability.

Trained on a bounded sample: LABELLED rows of each label outside the held-out fold (crc32 of the
id modulo 3 is 1), chosen by a hash of the id; whole texts, each at most BUCKETS columns long on the
driver whatever its length. Null or empty text: no terms, the bias alone. Very long texts are read
whole. Rows whose label is not 0 or 1 are not used; a document with both labels counts as toxic. No
labelled rows: score 0. Ties: a score at THRESHOLD is predicted 1. Repeated rows are scored alike.
Empty table: no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tempora.llm.common import Bounded, documents, fold, sampled, small_batches, table

BUCKETS = 1 << 18
RANK = 4
MIN_DOCS = 4
MIN_Z = 3.5
LABELLED = 4000
EPOCHS = 25
RATE = 0.1
SHRINK = 2e-4
#: How much stronger the shrinkage is below MIN_Z.
HELD = 300
SEED = 23
THRESHOLD = 0.7
#: Distinct terms whose column a worker remembers.
MEMO = 500_000

_TERM = re.compile(r"\w+")


class _Columns(dict):
    def __missing__(self, term: str) -> int:
        c = zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < MEMO:
            self[term] = c
        return c


_columns = _Columns()


def terms(text: str | None) -> np.ndarray:
    """The distinct columns of a text, ascending."""
    found = set(_TERM.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(map(_columns.__getitem__, found), dtype=np.int32, count=len(found)))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, columns: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Outputs for texts whose columns stand in a row, length of each."""
        out = np.full(len(length), self.bias)
        some = np.flatnonzero(length)
        if len(some):
            first = (np.cumsum(length) - length)[some]
            v = self.factor[columns]
            total = np.add.reduceat(v, first, axis=0)
            out[some] += np.add.reduceat(self.weight[columns], first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), first))
        return out

    def score(self, columns: np.ndarray, length: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(columns, length) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Machine:
    """A machine on rows of columns; the number of documents in a step is bounded."""
    rng = np.random.default_rng(seed)
    df = np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate([*(r for r, t in zip(rows, y) if t), np.empty(0, np.int32)]), minlength=BUCKETS)
    n, n1 = len(y), max(int(y.sum()), 1)
    n0 = max(n - n1, 1)
    share = df / n
    z = np.abs(toxic / n1 - (df - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    used = np.flatnonzero(df >= MIN_DOCS)
    shrink = np.append(np.where(z[used] >= MIN_Z, SHRINK, HELD * SHRINK), SHRINK)
    number = np.full(BUCKETS, -1, dtype=np.int64)
    number[used] = np.arange(len(used))
    rows = [number[r] for r in rows]
    rows = [r[r >= 0] for r in rows]
    w, v = np.zeros(len(used) + 1), rng.normal(0, 0.02, (len(used) + 1, RANK))
    gw, gv, gb, bias = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6, 0.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            length = np.array([len(rows[i]) for i in part])
            cols = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), length)
            vc = v[cols]
            total = np.stack([np.bincount(owner, vc[:, k], len(part)) for k in range(RANK)], axis=1)
            square = np.bincount(owner, (vc**2).sum(axis=1), len(part))
            out = bias + np.bincount(owner, w[cols], len(part)) + 0.5 * ((total**2).sum(axis=1) - square)
            err = (_sigmoid(out) - y[part]) / len(part)
            kinds, at = np.unique(cols, return_inverse=True)
            dw = np.bincount(at, err[owner], len(kinds)) + shrink[kinds] * w[kinds]
            pair = err[owner][:, None] * (total[owner] - vc)
            dv = np.stack([np.bincount(at, pair[:, k], len(kinds)) for k in range(RANK)], axis=1) + shrink[kinds, None] * v[kinds]
            gw[kinds] += dw**2
            gv[kinds] += dv**2
            w[kinds] -= RATE * dw / np.sqrt(gw[kinds])
            v[kinds] -= RATE * 0.5 * dv / np.sqrt(gv[kinds])
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / np.sqrt(gb)
    weight, factor = np.zeros(BUCKETS), np.zeros((BUCKETS, RANK))
    weight[used], factor[used] = w[:-1], v[:-1]
    return Machine(float(bias), weight, factor)


def calibrate(m: Machine, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Fit slope and shift by Newton steps on the weighted logistic loss, lightly held near the identity."""
    a, b = 1.0, 0.0
    weight = weight / weight.mean()
    for _ in range(50):
        p = _sigmoid(a * raw + b)
        g = np.array([(weight * (p - y) * raw).sum() + 0.1 * (a - 1), (weight * (p - y)).sum() + 1e-3 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * raw**2).sum() + 0.1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-8:
            break
    m.slope, m.shift = float(max(a, 0.05)), float(b)


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "key", "columns"])


class _Scores:
    def __init__(self, machine, keep: list[str]):
        self.machine, self.keep = machine, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = self.machine.value
        for b in batches:
            rows = [terms(t) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
            length = np.array([len(r) for r in rows], dtype=np.int64)
            score = m.score(np.concatenate([*rows, np.empty(0, np.int32)]), length) if m is not None else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in self.keep), pa.array(score)], names=[*self.keep, "score"])


def train(docs: DataFrame, labels: DataFrame):
    """A broadcast Machine; holds None without labelled rows of both kinds outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 3) != 1)).select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = labels.where(sampled(F.col("doc_id"), F.col("toxic"), counts, LABELLED, SEED)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("key"), "text")
    found = rows.mapInArrow(Bounded(_term_batches), f"toxic {dict(rows.dtypes)['toxic']}, key bigint, columns array<int>").toArrow().combine_chunks()
    y, key = found.column("toxic").to_numpy().astype(float), found.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    y, key = y[order], key[order]
    columns = found.column("columns").combine_chunks()
    at, flat = columns.offsets.to_numpy(), columns.values.to_numpy()
    x = [flat[at[i] : at[i + 1]] for i in order]
    aside = (key & 0xFF) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), dtype=bool)
    if len(set(y)) < 2:
        return spark.sparkContext.broadcast(None)
    m = fit([r for r, a in zip(x, aside) if not a], y[~aside])
    if not aside.any():
        aside = np.ones(len(y), dtype=bool)
    test = [r for r, a in zip(x, aside) if a]
    raw = m.raw(np.concatenate(test), np.array([len(r) for r in test]))
    t = y[aside]
    share = {k: n / max((t == k).sum(), 1) for k, n in counts.items()}
    calibrate(m, raw, t, np.array([share.get(int(k), 1.0) for k in t]))
    return spark.sparkContext.broadcast(m)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held, F.col("text").alias("_text")).mapInArrow(Bounded(_Scores(machine, ["doc_id", "held_out"])), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
