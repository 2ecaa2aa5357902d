"""Quality rules: exact rule statistics, and an isolation forest on them whose threshold labelled rows calibrate.

For each whole text the rules count words, word characters, symbols, repeated lines and words
in repeated three-word windows. A text fails outright below MIN_WORDS words or with more than
half of its words in repeated windows. From the counts come shares (FEATURES). The forest sees each
as its distance from the mean, in standard deviations. It grows on the labelled good rows that pass
the base rules, or on all documents that pass where these are fewer than SUBSAMPLE.
An isolation forest of N_TREES random trees over SUBSAMPLE rows each (drawn by a hash from all of these rows,
no row for two trees where there are enough), which cut a feature as often
as its rows are spread there, gives every text the path length that it would have as one more row:
at a node whose rows it lies beyond, a cut may part it from them all, so a kind of junk that the
rows lack is short of path too. The mean over the trees is turned into the usual anomaly score in
0 to 1. The threshold is the lowest of greatest accuracy,
balanced over labelled good and bad rows that pass the base rules, among those that lose no more
than MAX_LOSS of the good ones; it is never below the median score of all documents that pass.

Means, deviations, threshold and median are taken over all of the rows named. Their statistics are written to
the shared folder, and scores are counted in steps of 1 / STEPS, of which the threshold is one, so a row is on
the same side of it as its step. The driver gets the trees' rows and the steps, whatever the size of the tables.

Null or empty text: no words, fails the base rules. Very long texts are counted whole. No labelled rows:
only the base rules apply. Ties: a score at the threshold is kept, and of equal thresholds the lowest
counts. Repeated rows are judged alike; a document with two labels counts as the lesser. Empty table:
no rows. Extra columns, whatever their names, are not read, and the kept rows carry them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tempora.functions.lineage import release
from tempora.llm.common import Bounded, GRAIN, documents, materialize, schema_with, small_batches, table, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
N_TREES = 100
SUBSAMPLE = 256
MAX_LOSS = 0.01
#: Steps of a score that are counted for the threshold; a power of two, so that a step is an exact number.
STEPS = 1 << 16
#: What counts as a standard deviation of a share in which no two rows differ.
UNSEEN = 0.001
SEED = 17

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that the forest looks at.
FEATURES = ("symbols", "repeated_lines", "repeated_words", "upper", "digits", "marks", "bare", "long_words")

_BLANKS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _MARKS = b"0123456789", b"!?;:\"'()[]{}=+_~^@/\\"
_CONTINUED = bytes(range(0x80, 0xC0))
#: What a word is bare of letters and digits with.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # else the product below fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, _BLANKS)
    chars = len(solid) - (0 if text.isascii() else len(solid) - len(solid.translate(None, _CONTINUED)))
    without = lambda kind: len(solid) - len(solid.translate(None, kind))
    symbols = without(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = _repeated(words)
    n, c = max(len(words), 1), max(chars, 1)
    upper, lower = without(_UPPER), without(_LOWER)
    features = [symbols / c, dup / max(len(lines), 1), repeat / n, upper / max(upper + lower, 1), without(_DIGITS) / c, without(_MARKS) / c, sum(not w.strip(_PUNCTUATION) for w in words) / n, chars / n]
    return [len(words), chars, symbols, dup, repeat], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


# ---- isolation forest

def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # by tree and node; -1 at a leaf
    cut: np.ndarray
    child: np.ndarray  # the left child; the right one follows it
    depth: np.ndarray  # of a leaf, with the mean path of its rows
    low: np.ndarray  # by tree, node and feature: the bounds of the node's rows
    high: np.ndarray
    middle: np.ndarray  # by feature
    unit: np.ndarray
    norm: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        x = scaled(x, self.middle, self.unit)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, k, d, low, high in zip(self.feature, self.cut, self.child, self.depth, self.low, self.high):
            spread = (high - low).sum(axis=1)
            node, still, level = np.zeros(len(x), dtype=np.int64), np.ones(len(x)), 0
            at = rows
            while len(at):
                n = node[at]
                beyond = (np.maximum(low[n] - x[at], 0) + np.maximum(x[at] - high[n], 0)).sum(axis=1)
                parted = still[at] * np.divide(beyond, beyond + spread[n], out=np.zeros(len(at)), where=beyond > 0)
                total[at] += parted * (level + 1)
                still[at] -= parted
                inner = f[n] >= 0
                total[at[~inner]] += still[at[~inner]] * d[n[~inner]]
                at, n = at[inner], n[inner]
                node[at] = k[n] + (x[at, f[n]] >= c[n])
                level += 1
        return 2.0 ** (-total / len(self.feature) / self.norm)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By feature, the mean and the standard deviation."""
    return x.mean(axis=0), _seen(np.where(np.ptp(x, axis=0) > 0, x.std(axis=0), 0.0))


def _seen(unit: np.ndarray) -> np.ndarray:
    """For a feature that all rows agree in (0), UNSEEN or the least of the others' deviations if that is less."""
    return np.where(unit > 0, unit, min([UNSEEN, *unit[unit > 0]]))


def scaled(x: np.ndarray, middle: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return (x - middle) / unit


def grow(x: np.ndarray, seed: int = SEED, scale: tuple[np.ndarray, np.ndarray] | None = None) -> Forest:
    """scale: the units of all rows, where x holds those that were drawn for the trees."""
    rng = np.random.default_rng(seed)
    middle, unit = scale or units(x)
    x = scaled(x, middle, unit)
    size = min(SUBSAMPLE, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    deal = rng.permutation(len(x)) if len(x) >= N_TREES * size else None
    trees = []
    for k in range(N_TREES):
        blank = (-1, 0.0, 0, 0.0, None, None)
        tree = [list(blank)]
        todo = [(0, x[rng.choice(len(x), size, replace=False) if deal is None else deal[k * size : (k + 1) * size]], 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            tree[node][4:] = low, high
            spread = high - low
            if level >= limit or len(rows) <= 1 or not spread.any():
                tree[node][3] = level + float(_mean_path(len(rows)))
                continue
            f = int(rng.choice(len(spread), p=spread / spread.sum()))
            c = float(high[f] - rng.uniform(0, spread[f]))  # over low, so that no part is empty
            tree[node][:3] = f, c, len(tree)
            for part in (rows[rows[:, f] < c], rows[rows[:, f] >= c]):
                todo.append((len(tree), part, level + 1))
                tree.append(list(blank))
        trees.append(tree)
    n, none = max(map(len, trees)), np.zeros(x.shape[1])
    pad = lambda i, v: np.array([[node[i] for node in t] + [v] * (n - len(t)) for t in trees])
    return Forest(pad(0, -1), pad(1, 0.0), pad(2, 0), pad(3, 0.0), pad(4, none), pad(5, none), middle, unit, float(_mean_path(size)) or 1.0)


def _beyond(score: np.ndarray, n: np.ndarray | None, cuts: np.ndarray) -> np.ndarray:
    """The share of rows above each cut."""
    order = np.argsort(score)
    total = np.concatenate([[0], np.cumsum(np.ones(len(score)) if n is None else n[order])])
    return 1 - total[np.searchsorted(score[order], cuts, side="right")] / total[-1]


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, usual: float, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The threshold above which a score is anomalous, from labelled scores; n_good and n_bad: how many rows have each, one unless given."""
    if not len(good) or not len(bad):
        return np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    loss, hit = _beyond(good, n_good, cuts), _beyond(bad, n_bad, cuts)
    ok = (loss <= MAX_LOSS) & (cuts >= usual)
    if not ok.any():
        return np.inf
    return float(cuts[ok][np.argmax((hit - loss)[ok])])


# ---- Spark

class _Statistics:
    """Batches with a column _text; gives the others, COUNTS and FEATURES."""

    def __init__(self, keep: list[str]):
        self.keep = keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, features = _of_batch(b)
            cols = [b.column(b.schema.get_field_index(n)) for n in self.keep]
            cols += [pa.array(c, pa.int64()) for c in counts.T] + [pa.array(np.ascontiguousarray(c), pa.float64()) for c in features.T]
            yield pa.RecordBatch.from_arrays(cols, names=[*self.keep, *COUNTS, *FEATURES])


def _of_batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(t) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
    return np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS)), np.array([f for _, f in found]).reshape(-1, len(FEATURES))


class _Scores:
    """Batches with FEATURES; gives the columns keep and the anomaly."""

    def __init__(self, forest, keep: list[str]):
        self.forest, self.keep = forest, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = self.forest.value
        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(f)).to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in self.keep), pa.array(forest.score(x))], names=[*self.keep, "anomaly"])


class _Kept:
    """Batches with columns doc and _text; gives doc of the kept rows."""

    def __init__(self, forest):
        self.forest = forest

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = self.forest.value
        for b in batches:
            counts, features = _of_batch(b)
            kept = ~base_failed(counts)
            if forest is not None:
                kept &= forest.score(features) <= forest.threshold
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc"))], names=["doc"]).filter(pa.array(kept))


_STAT_TYPES = ", ".join([f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in FEATURES])
_FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
_PASSED = f"not {_FAILED}"


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, FEATURES and quality (null without a label) of every document, written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    rows = rows.mapInArrow(Bounded(_Statistics(["doc_id"])), schema_with(rows, ["doc_id"], _STAT_TYPES))
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return materialize(rows.join(marked, "doc_id", "left"), "quality-statistics")


def _grown(rows: DataFrame) -> Forest | None:
    """The forest of measured rows; None if there are none."""
    good = F.expr(f"{_PASSED} and quality = 1")
    n = rows.agg(F.count("*"), F.count_if(F.expr(_PASSED)), F.count_if(good)).first()
    if not n[0]:
        return None
    of, n = (rows.where(good), n[2]) if n[2] >= SUBSAMPLE else (rows.where(_PASSED), n[1]) if n[1] >= 2 else (rows, n[0])
    spread = of.agg(*[g(f) for f in FEATURES for g in (F.avg, F.stddev_pop, F.min, F.max)]).first()
    # Spark adds up in any order: what differs in the last digits is the same here
    middle, unit = (np.array([float(f"{v:.9g}") for v in spread[i::4]]) for i in (0, 1))
    unit[np.array(spread[3::4]) == np.array(spread[2::4])] = 0
    key = F.xxhash64("doc_id", *COUNTS, *FEATURES, F.lit(SEED))
    drawn, most = of, N_TREES * SUBSAMPLE
    if n > most:
        drawn = of.where(F.pmod(key, F.lit(GRAIN)) < min(GRAIN, GRAIN * most * 11 // (10 * n)))  # a tenth more than the trees take
        drawn = of.limit(most) if drawn.isEmpty() else drawn
    found = drawn.select(key.alias("key"), *COUNTS, *FEATURES).toArrow()
    found = found.take(np.argsort(found.column("key").to_numpy())[:most])
    col = lambda name: found.column(name).to_numpy()
    order = np.lexsort([col(name) for name in (*FEATURES, *COUNTS)])  # the same rows give the same forest in any order
    x = np.stack([col(f) for f in FEATURES], axis=1)[order]
    return grow(x, scale=(middle, _seen(unit)))


def _fitted(docs: DataFrame, labels: DataFrame):
    """A broadcast Forest, and doc_id, COUNTS, quality and anomaly of all documents, written to the shared folder; None and no rows without documents."""
    spark = docs.sparkSession
    rows = measured(docs, labels)
    forest = _grown(rows)
    if forest is None:
        return spark.sparkContext.broadcast(None), rows.drop(*FEATURES).withColumn("anomaly", F.lit(0.0))
    keep = ["doc_id", "quality", *COUNTS]
    draft = spark.sparkContext.broadcast(forest)
    scored = materialize(rows.mapInArrow(Bounded(_Scores(draft, keep)), schema_with(rows, keep, "anomaly double")), "quality-scores")
    draft.unpersist()
    release(rows)
    steps = scored.where(_PASSED).groupBy("quality", F.ceil(F.col("anomaly") * STEPS).cast("bigint").alias("step")).agg(F.count("*").alias("n")).toArrow()
    quality, step, n = (steps.column(c).to_numpy().astype(float) for c in ("quality", "step", "n"))
    step /= STEPS
    order = np.argsort(step)
    usual = step[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)] if len(n) else 0.0
    good, bad = quality == 1, quality == 0
    forest.threshold = calibrate(forest, step[good], step[bad], float(usual), n[good], n[bad])
    return spark.sparkContext.broadcast(forest), scored


def fit(docs: DataFrame, labels: DataFrame):
    """A broadcast Forest fitted on docs and calibrated on labels, all rows of both; holds None if there are no documents."""
    return _fitted(docs, labels)[0]


def judge(docs: DataFrame, labels: DataFrame, only_kept: bool = False) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept; or the rows that are kept, with all their own columns."""
    forest, scored = _fitted(docs, labels)
    if only_kept:
        release(scored)
        rows = docs.select(whole(docs), F.col("text").cast("binary").alias("_text"))
        return rows.mapInArrow(Bounded(_Kept(forest)), schema_with(rows, ["doc"])).select("doc.*")
    limit = F.lit(float(forest.value.threshold) if forest.value is not None else np.inf)
    return scored.select("doc_id", *COUNTS, F.expr(_FAILED).alias("base_failed"), "anomaly", (F.expr(_PASSED) & (F.col("anomaly") <= limit)).alias("kept"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
