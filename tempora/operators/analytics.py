"""Graph algorithms over a vertex table (id) and an edge table (id, src, dst and properties).

Loops keep their state in written tables, so an iteration is one plan of joins and partial
aggregations, and a lost executor costs one iteration. Every result has a defined order or none.
Empty graphs give empty results; dangling edges raise, as does a missing, negative or non-finite
weight where one is used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tempora.functions.components import components
from tempora.functions.lineage import materialize, numbered, release
from tempora.operators import temporal


class AnalyticsError(ValueError):
    """code: INVALID-REQUEST, RESOURCE-LIMIT, ITERATION-LIMIT, INVALID-PROPERTY, MISSING-PROPERTY or DANGLING-EDGE."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Projection:
    """The graph that algorithms run on, with the caps that guard them.

    max_iterations bounds the rounds of every loop, max_work the rows that rounds go over (edges and vertices, once a round),
    max_pairs the (source, vertex) pairs that all-pairs algorithms hold at a time, max_task the links that louvain holds in one task,
    which are refused beyond it, as they are in dfs beyond 2^24 of them. None: no bound.
    """

    vertices: DataFrame
    edges: DataFrame
    max_iterations: int = 10_000
    max_work: int | None = None
    max_pairs: int | None = None
    max_task: int | None = 1 << 27
    used: int = 0
    size: int | None = None

    def check(self) -> "Projection":
        """Raise on edges whose ends are not vertices or on repeated edge ids."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(self.vertices, "id", "left_anti").isEmpty():
            raise AnalyticsError("DANGLING-EDGE", "an edge has an end that is no vertex")
        if not self.edges.groupBy("id").count().where("count > 1").isEmpty():
            raise AnalyticsError("INVALID-REQUEST", "an edge id is repeated")
        return self

    def rounds(self, n: int) -> int:
        if not 1 <= n <= self.max_iterations:
            raise AnalyticsError("ITERATION-LIMIT", f"{n} iterations; at most {self.max_iterations}")
        return n

    def round(self, n: int) -> None:
        """Account for the n-th round of a loop."""
        if n > self.max_iterations:
            raise AnalyticsError("ITERATION-LIMIT", f"more than {self.max_iterations} rounds")
        if self.max_work is not None:
            if self.size is None:
                self.size = self.edges.count() + self.vertices.count()
            self.used += self.size
            if self.used > self.max_work:
                raise AnalyticsError("RESOURCE-LIMIT", f"more than {self.max_work} rows of work")

    def one_task(self, rows: DataFrame, key: str, links=None, most: int | None = None) -> None:
        """Refuse rows of which one key's are too many for a task, or their links; most: a bound besides max_task."""
        if self.max_task is None:
            return
        most = self.max_task if most is None else min(most, self.max_task)
        if not rows.groupBy(key).agg(F.sum(F.lit(1) if links is None else links).alias("n")).where(F.col("n") > most).isEmpty():
            raise AnalyticsError("RESOURCE-LIMIT", f"more than {most} links in one task")

    def has(self, vertex: int) -> None:
        if self.vertices.where(F.col("id") == vertex).isEmpty():
            raise AnalyticsError("INVALID-REQUEST", f"no vertex {vertex}")


#: Rows that a join may broadcast, and pairs that a task of one-edge extensions holds.
SMALL = 1 << 20


def _undirected(g: Projection) -> DataFrame:
    """The simple undirected graph as distinct (a, b) in both directions, without loops. Dealt out first, so that no task holds all
    pairs of a large split."""
    e = g.edges.where(F.col("src") != F.col("dst"))
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.a", "x.b")
    return both.repartition(-(-g.edges.count() // (SMALL // 2)) or 1, "a", "b").distinct()


def _weights(edges: DataFrame, weight: str | None) -> DataFrame:
    return edges.select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))


# ---- traversal

def bfs(g: Projection, source: int, max_depth: int = 64) -> DataFrame:
    """position, vertex, depth: by layer, then by the place of the first parent, then by id."""
    g.has(source)
    e = g.edges.select("src", "dst").distinct()
    done = g.vertices.where(F.col("id") == source).select(F.col("id").alias("vertex"), F.lit(0).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("depth")).distinct()
    layer, n = done, 1
    for depth in range(1, max_depth + 1):
        g.round(depth)
        found = layer.join(e, layer["vertex"] == e["src"]).groupBy(F.col("dst").alias("vertex")).agg(F.min("position").alias("parent"))
        found = found.join(done.select("vertex"), "vertex", "left_anti")
        layer = numbered(found, [F.col("parent"), F.col("vertex")], "position", n).select("vertex", "position", F.lit(depth).cast("bigint").alias("depth"))
        size = layer.count()
        if not size:
            break
        n += size
        old, done = done, materialize(done.unionByName(layer), "bfs")
        release(old)
    return done.select("position", "vertex", "depth")


def dfs(g: Projection, source: int, max_depth: int = 64) -> DataFrame:
    """position, vertex: a stack that marks vertices when they are pushed. Sequential by nature: the part within reach is walked in one task."""
    within = materialize(bfs(g, source, max_depth).select("vertex"), "dfs")
    e = g.edges.select("src", "dst").distinct().join(within.select(F.col("vertex").alias("src")), "src", "left_semi").join(within.select(F.col("vertex").alias("dst")), "dst", "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(x, reverse=True) for k, x in pdf[pdf.src != pdf.dst].groupby("src")["dst"]}
        stack, seen, out = [(source, 0)], {source}, []
        while stack:
            v, depth = stack.pop()
            out.append(v)
            if depth < max_depth:
                for u in near.get(v, ()):
                    if u not in seen:
                        seen.add(u)
                        stack.append((u, depth + 1))
        return pd.DataFrame({"position": range(len(out)), "vertex": out})

    start = within.where(F.col("vertex") == source).select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"))
    rows = materialize(e.select("src", "dst").unionByName(start).withColumn("one", F.lit(True)), "dfs")
    g.one_task(rows, "one", most=1 << 24)
    return rows.groupBy("one").applyInPandas(walk, "position bigint, vertex bigint")


# ---- shortest paths

def _entered(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vertices that edges enter, these vertices' edges, and the edges of all others. No path comes back to the others, so what
    starts there is one edge and what starts at its end: they need no rounds of their own."""
    core = materialize(e.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("id")).distinct(), "entered")
    heads = core.select(F.col("id").alias("src"))
    return core, e.join(heads, "src", "left_semi"), e.where(F.col("src") != F.col("dst")).join(heads, "src", "left_anti")


def _extended(outer: DataFrame, reach: DataFrame) -> DataFrame:
    """source, vertex, distance over one edge of outer (src, dst, w) and then as in reach (source, vertex, distance).

    A small reach is broadcast to edges that are dealt by source, so that no pair is shuffled.
    """
    size = reach.count()
    reach = reach.select(F.col("source").alias("dst"), "vertex", "distance")
    if size <= SMALL:
        most = outer.select("src").distinct().count() * min(size, reach.select("vertex").distinct().count())
        parts = max(int(outer.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // SMALL))
        outer, reach = outer.repartition(parts, "src"), F.broadcast(reach)
    found = outer.join(reach, "dst").groupBy(F.col("src").alias("source"), "vertex")
    return found.agg(F.min(F.col("w") + F.col("distance")).alias("distance"))


def _lightest(g: Projection, weight: str | None) -> DataFrame:
    """src, dst, w of the lightest of parallel edges, none and bad where one of them has no or no right weight."""
    e = _weights(g.edges, weight)
    e = e.groupBy("src", "dst").agg(F.min("w").alias("w"), F.max((F.col("w").isNull()).cast("int")).alias("none"), F.max((F.isnan("w") | (F.abs("w") == math.inf) | (F.col("w") < 0)).cast("int")).alias("bad"))
    return materialize(e, "relax-edges")


def _refuse(edges: DataFrame) -> bool:
    """Raise on edges that are marked; false if there were none."""
    bad = edges.agg(F.max("none"), F.max("bad")).first()
    if bad[0]:
        raise AnalyticsError("MISSING-PROPERTY", "an edge has no weight")
    if bad[1]:
        raise AnalyticsError("INVALID-PROPERTY", "a weight is negative or not finite")
    return False


def _relax(g: Projection, e: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Least distances keys + vertex -> distance from start over the lightest edges, by relaxing what changed until nothing does."""
    marked = not e.where("none = 1 OR bad = 1").isEmpty()
    best = frontier = both = materialize(start, "relax")
    for n in count(1):
        g.round(n)
        scanned = frontier.join(e, frontier["vertex"] == e["src"])
        if marked:
            _refuse(scanned)
        found = scanned.select(*keys, F.col("dst").alias("vertex"), (F.col("distance") + F.col("w")).alias("distance"))
        found = found.groupBy(*keys, "vertex").agg(F.min("distance").alias("new"))
        met = best.join(found, [*keys, "vertex"], "full_outer")
        old, both = both, materialize(met.select(*keys, "vertex", F.least("distance", "new").alias("distance"), (F.col("distance").isNull() | (F.col("new") < F.col("distance"))).alias("changed")), "relax")
        release(old)
        best, frontier = both.drop("changed"), both.where("changed").drop("changed")
        if frontier.isEmpty():
            return best


def bounded_sssp(g: Projection, source: int, weight: str | None = None) -> DataFrame:
    """vertex, distance of what can be reached."""
    g.has(source)
    start = g.vertices.where(F.col("id") == source).select(F.col("id").alias("vertex"), F.lit(0.0).alias("distance")).distinct()
    return _relax(g, _lightest(g, weight), start, [])


def bounded_apsp(g: Projection, weight: str | None = None, max_pairs: int = 4096) -> DataFrame:
    """source, target, distance of all pairs that can be reached, (v, v) included."""
    n = g.vertices.count()
    if n * n > max_pairs:
        raise AnalyticsError("RESOURCE-LIMIT", f"{n * n} pairs; at most {max_pairs}")
    e = _lightest(g, weight)
    _refuse(e)
    core, inner, outer = _entered(e)
    itself = lambda v: v.select(F.col("id").alias("source"), F.col("id").alias("vertex"), F.lit(0.0).alias("distance"))
    reach = _relax(g, materialize(inner, "relax-edges"), itself(core), ["source"])
    found = reach.unionByName(itself(g.vertices.join(core, "id", "left_anti"))).unionByName(_extended(outer, reach))
    return found.select("source", F.col("vertex").alias("target"), "distance")


# ---- components

def weakly_connected_components(g: Projection) -> DataFrame:
    """component (its least vertex), vertex."""
    e = g.edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = components(e)
    return g.vertices.join(e, g.vertices["id"] == e["u"], "left").select(F.coalesce("v", "id").alias("component"), F.col("id").alias("vertex"))


def _spread(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """nodes (id, by and label) with the least label that reaches each along edges (a, b) whose ends agree in by."""
    state = new = materialize(nodes, "spread")
    while True:
        got = edges.join(state.select(F.col("id").alias("a"), F.col("label"), F.col(by).alias("_ba")), "a")
        got = got.join(state.select(F.col("id").alias("b"), F.col(by).alias("_bb")), "b").where(F.col("_ba") == F.col("_bb")).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("new"))
        met = state.join(got, "id", "left")
        old, new = new, materialize(met.select("id", by, F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("changed")), "spread")
        release(old)
        state = new.drop("changed")
        if new.where("changed").isEmpty():
            return state


def strongly_connected_components(g: Projection) -> DataFrame:
    """component (its least vertex), vertex: least labels forward, then back from their roots within each colour, until none is left."""
    left, n = materialize(g.vertices.select("id"), "scc"), 0
    edges = materialize(g.edges.where(F.col("src") != F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "scc")
    out = None
    while not left.isEmpty():
        n += 1
        g.round(n)
        into, outof = edges.select(F.col("b").alias("id")).distinct(), edges.select(F.col("a").alias("id")).distinct()
        alone = left.join(into.intersect(outof), "id", "left_anti")
        part = alone.select(F.col("id").alias("component"), F.col("id").alias("vertex"))
        core = left.join(alone, "id", "left_anti")
        colour = _spread(core.select("id", F.lit(0).alias("all"), F.col("id").alias("label")), edges, "all").select("id", F.col("label").alias("colour"))
        colour = materialize(colour, "scc")
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        mark = _spread(colour.select("id", "colour", F.when(F.col("id") == F.col("colour"), F.lit(0)).otherwise(F.lit(1)).alias("label")), back, "colour")
        part = materialize(part.unionByName(mark.where("label = 0").select(F.col("colour").alias("component"), F.col("id").alias("vertex"))), "scc")
        out = part if out is None else out.unionByName(part)
        gone = part.select(F.col("vertex").alias("id"))
        left = materialize(left.join(gone, "id", "left_anti"), "scc")
        edges = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        edges = materialize(edges.select("a", "b"), "scc")
    out = out if out is not None else left.select(F.col("id").alias("component"), F.col("id").alias("vertex"))
    return out.withColumn("component", F.min("vertex").over(W.partitionBy("component")))


# ---- centrality

def page_rank(g: Projection, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """vertex, score: a fixed number of synchronous rounds, dangling mass spread evenly, scaled to one at the end."""
    g.rounds(iterations)
    if not 0 <= damping < 1:
        raise AnalyticsError("INVALID-REQUEST", "damping must be in [0, 1)")
    n = g.vertices.count()
    if not n:
        return g.vertices.select(F.col("id").alias("vertex"), F.lit(0.0).alias("score"))
    pairs = g.edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = materialize(g.vertices.select("id").join(degree, F.col("id") == F.col("src"), "left").select("id", "degree"), "rank-nodes")
    pairs = materialize(pairs.join(degree, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("share")), "rank-edges")
    rank, kept = nodes.withColumn("r", F.lit(1.0 / n)), None
    for i in range(iterations):
        g.round(i + 1)
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("r"))), F.lit(0.0)).alias("d"))
        got = pairs.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("r")).alias("got"))
        rank = nodes.join(got, nodes["id"] == got["dst"], "left").crossJoin(F.broadcast(dangling))  # one row
        rank = rank.select("id", "degree", (F.lit((1 - damping) / n) + damping * F.col("d") / n + damping * F.coalesce("got", F.lit(0.0))).alias("r"))
        if i % 4 == 3 or i == iterations - 1:
            old, kept = kept, materialize(rank, "rank")
            rank = kept
            release(old)
    total = rank.agg(F.sum("r")).first()[0]
    return rank.select(F.col("id").alias("vertex"), (F.col("r") / (total or 1.0)).alias("score"))


def degree_centrality(g: Projection) -> DataFrame:
    """vertex, score: in and out degree over the number of other vertices."""
    n = max(g.vertices.count() - 1, 1)
    d = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return g.vertices.join(d, "id", "left").select(F.col("id").alias("vertex"), (F.coalesce("d", F.lit(0)) / F.lit(float(n))).alias("score"))


def _sources(g: Projection) -> list[DataFrame]:
    """The vertices as sources, in as many hashed parts as keep the pairs of a part near max_pairs."""
    n = g.vertices.count()
    parts = 1 if g.max_pairs is None else min(max(1, -(-n * n // max(g.max_pairs, 1))), max(n, 1))
    return [g.vertices.select("id").where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) for k in range(parts)]


def _hops(g: Projection, sources: DataFrame) -> list[DataFrame]:
    """source, vertex of all that each source reaches, a written layer for each depth."""
    e = materialize(g.edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "hops")
    seen = layer = materialize(sources.select(F.col("id").alias("source"), F.col("id").alias("vertex")), "hops")
    layers = [layer]
    for n in count(1):
        g.round(n)
        new = layer.join(e, layer["vertex"] == e["src"]).select("source", F.col("dst").alias("vertex")).distinct()
        layer = materialize(new.join(seen, ["source", "vertex"], "left_anti"), "hops")
        if layer.isEmpty():
            release(e, layer)
            return layers
        layers.append(layer)
        seen = seen.unionByName(layer)


def closeness_centrality(g: Projection) -> DataFrame:
    """vertex, score: reached squared over others times the sum of hop distances; 0 if nothing is reached."""
    n, near = g.vertices.count(), None
    e = materialize(g.edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "closeness")
    core, inner, outer = _entered(e)
    within = replace(g, vertices=core, edges=materialize(inner, "closeness"), size=None)
    for sources in _sources(within):
        for depth, layer in enumerate(_hops(within, sources)):
            part = layer.withColumn("distance", F.lit(depth).cast("bigint"))
            near = part if near is None else near.unionByName(part)
    far = _extended(outer.withColumn("w", F.lit(1).cast("bigint")), near)
    sums = [F.count("*").alias("r"), F.sum("distance").alias("s")]
    parts = near.where("distance > 0").groupBy("source").agg(*sums).unionByName(far.groupBy("source").agg(*sums))
    score = F.when(F.col("s").isNull(), 0.0).otherwise(F.col("r") * F.col("r") / (F.lit(float(max(n - 1, 1))) * F.col("s")))
    return g.vertices.join(parts, g.vertices["id"] == parts["source"], "left").select(F.col("id").alias("vertex"), score.alias("score"))


def _dependencies(g: Projection, e: DataFrame, sources: DataFrame) -> DataFrame:
    """vertex, d: the dependencies of these sources on each vertex, path counts forward by layer and shares back."""
    layers = _hops(g, sources)
    sigma = [materialize(layers[0].withColumn("paths", F.lit(1.0)), "paths")]
    for at in layers[1:]:
        got = sigma[-1].join(e, F.col("vertex") == F.col("src")).groupBy("source", F.col("dst").alias("vertex")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        sigma.append(materialize(got.join(at, ["source", "vertex"]), "paths"))
    release(*layers)
    delta = sigma[-1].select("source", "vertex", "paths", F.lit(0.0).alias("d"))
    total, written = None, []
    for up in sigma[-2::-1]:
        part = delta.select("vertex", "d")
        total = part if total is None else total.unionByName(part)
        lower = delta.select("source", F.col("vertex").alias("dst"), ((1 + F.col("d")) / F.col("paths")).alias("x"))
        got = up.join(e, up["vertex"] == e["src"]).join(lower, ["source", "dst"]).groupBy("source", "vertex").agg(F.sum(F.col("paths") * F.col("k") * F.col("x")).alias("d"))
        delta = materialize(up.join(got, ["source", "vertex"], "left").select("source", "vertex", "paths", F.coalesce("d", F.lit(0.0)).alias("d")), "paths")
        written.append(delta)
    if total is None:
        return sigma[0].limit(0).select("vertex", F.lit(0.0).alias("d"))
    out = materialize(total.groupBy("vertex").agg(F.sum("d").alias("d")), "betweenness")
    release(*sigma, *written)
    return out


#: Vertices whose edges a task may hold as a square of numbers: 8 MB.
SQUARE = 1 << 10


def _outer_dependencies(core: DataFrame, inner: DataFrame, outer: DataFrame) -> DataFrame:
    """vertex, d: the dependencies of the sources of outer (src, dst, k) on a core of at most SQUARE vertices, whose edges each task holds.
    Sources are gone through in blocks; a task gives one sum for each vertex of the core, so no pair is written or shuffled."""
    ids = np.sort(np.array([r["id"] for r in core.collect()], dtype=np.int64))
    k = np.zeros((len(ids), len(ids)))
    for r in inner.where(F.col("src") != F.col("dst")).collect():  # at most SQUARE squared
        k[np.searchsorted(ids, r["src"]), np.searchsorted(ids, r["dst"])] = r["k"]

    def block(paths: np.ndarray) -> np.ndarray:
        depth = np.where(paths > 0, 1, 0)
        new, at = paths, 1
        while True:
            ends = (new > 0).any(axis=0)
            got = new[:, ends] @ k[ends]
            first = (got > 0) & (depth == 0)
            if not first.any():
                break
            at += 1
            depth[first] = at
            new = np.where(first, got, 0.0)
            paths = paths + new
        d = np.zeros(paths.shape)
        for up in range(at - 1, 0, -1):
            below = depth == up + 1
            ends = below.any(axis=0)
            share = np.divide(1 + d, paths, out=np.zeros(paths.shape), where=below)
            d = np.where(depth == up, paths * (share[:, ends] @ k[:, ends].T), d)
        return d.sum(axis=0)

    def walk(batches):
        total = np.zeros(len(ids))
        for b in batches:
            lists = b.column(0)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            dst, many = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            for i in range(0, len(lists), SQUARE):
                here = slice(*np.searchsorted(row, [i, i + SQUARE]))
                paths = np.zeros((min(SQUARE, len(lists) - i), len(ids)))
                paths[row[here] - i, np.searchsorted(ids, dst[here])] = many[here]
                total += block(paths)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vertex", "d"])

    parts = max(int(outer.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-outer.count() // SMALL))
    near = outer.repartition(parts, "src").groupBy("src").agg(F.collect_list(F.struct("dst", "k")).alias("near"))
    return near.select("near").mapInArrow(walk, "vertex bigint, d double").groupBy("vertex").agg(F.sum("d").alias("d"))


def betweenness_centrality(g: Projection) -> DataFrame:
    """vertex, score: shares of shortest paths of all sources, part by part; parallel edges multiply paths."""
    e = materialize(g.edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("k")), "paths")
    core, inner, outer = _entered(e)
    if core.count() <= SQUARE:
        inner = materialize(inner, "paths")
        graph, total = replace(g, vertices=core, edges=inner, size=None), _outer_dependencies(core, inner, outer)
    else:
        graph, inner, total = g, e, None
    for sources in _sources(graph):
        part = _dependencies(graph, inner, sources)
        total = part if total is None else total.unionByName(part)
    total = total.groupBy("vertex").agg(F.sum("d").alias("d"))
    return g.vertices.join(total, g.vertices["id"] == total["vertex"], "left").select(F.col("id").alias("vertex"), F.coalesce("d", F.lit(0.0)).alias("score"))


def _triangles(g: Projection) -> DataFrame:
    """Each triangle once. Edges point from the end of lower degree, so no vertex sends out more than the root of twice their number."""
    u = _undirected(g)
    d = u.groupBy("a").agg(F.count("*").alias("d"))
    p = u.join(d, "a").select("a", "b", F.struct("d", "a").alias("ra")).join(d.select(F.col("a").alias("b"), F.struct("d", F.col("a").alias("x")).alias("rb")), "b")
    p = materialize(p.where(F.struct(F.col("ra.d"), F.col("ra.a")) < F.struct(F.col("rb.d"), F.col("rb.x"))).select("a", "b", "rb"), "triangles")
    two = p.alias("l").join(p.alias("r"), "a").where(F.col("l.rb") < F.col("r.rb")).select("a", F.col("l.b").alias("b"), F.col("r.b").alias("c"))
    third = p.select(F.col("a").alias("b"), F.col("b").alias("c"))
    third = materialize(third.join(p.select("b").distinct(), "b", "left_semi"), "triangles")  # no other edge closes a pair
    if third.count() <= SMALL:
        return two.join(F.broadcast(third), ["b", "c"], "left_semi")
    pairs = p.groupBy("a").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    parts = -(-pairs // (8 * SMALL))
    return two.repartition(parts, "b", "c").join(third.repartition(parts, "b", "c"), ["b", "c"], "left_semi")


def triangle_count(g: Projection) -> DataFrame:
    """count of triangles of the simple undirected graph."""
    return _triangles(g).agg(F.count("*").alias("count"))


def clustering_coefficient(g: Projection) -> DataFrame:
    """vertex, score: linked pairs of neighbours over all pairs; 0 below two neighbours."""
    t = _triangles(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = _undirected(g).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    rows = g.vertices.join(d, "id", "left").join(t, "id", "left")
    score = F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return rows.select(F.col("id").alias("vertex"), score.alias("score"))


# ---- communities

def k_core(g: Projection) -> DataFrame:
    """vertex, core: the h-index of the neighbours' values, from the degrees down to the fixpoint, which is the core number."""
    u = materialize(_undirected(g), "core-edges")
    state = materialize(g.vertices.select("id").join(u.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("core")), "id", "left").na.fill(0, ["core"]), "core")
    new = state
    for n in count(1):
        g.round(n)
        near = u.join(state.select(F.col("id").alias("b"), "core"), "b").groupBy("a", "core").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(W.partitionBy("a").orderBy(F.desc("core")))
        h = near.withColumn("m", F.least("core", at_least)).groupBy(F.col("a").alias("id")).agg(F.max("m").alias("h"))
        old, new = new, materialize(state.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), (F.col("h") < F.col("core")).alias("changed")), "core")
        release(old)
        state = new.drop("changed")
        if new.where("changed").isEmpty():
            return state.select(F.col("id").alias("vertex"), F.col("core").cast("int").alias("core"))


def _renumbered(state: DataFrame, label: str) -> DataFrame:
    """vertex, community: labels as 1..n in ascending order."""
    kinds = numbered(state.select(label).distinct(), [F.col(label)], "community", 1)
    return state.join(kinds, label).select(F.col("id").alias("vertex"), "community")


def label_propagation(g: Projection, iterations: int = 20) -> DataFrame:
    """vertex, community: each round every vertex takes its neighbours' commonest label, the smallest of equals."""
    g.rounds(iterations)
    u = materialize(_undirected(g), "labels")
    state = new = materialize(g.vertices.select("id", F.col("id").alias("label")), "labels")
    for i in range(iterations):
        g.round(i + 1)
        votes = u.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("new"))
        old, new = new, materialize(state.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("changed")), "labels")
        release(old)
        state = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    return _renumbered(state, "label")


def louvain(g: Projection, iterations: int = 20) -> DataFrame:
    """vertex, community: one level of local moves in id order. Moves never leave a weak component, so components run side by side; one is one task's work, at about 16 bytes a link."""
    g.rounds(iterations)
    u = materialize(_undirected(g), "louvain")
    total = float(u.count())
    parts = weakly_connected_components(g).select(F.col("vertex").alias("a"), "component")
    near = u.groupBy("a", F.shiftright("b", 10).alias("block")).agg(F.collect_list("b").alias("near"))  # at most 1,024 in a list
    rows = materialize(near.join(parts, "a").select("component", "a", "near"), "louvain")
    release(u)
    g.one_task(rows, "component", F.size("near"))

    def moves(batches):
        owner, sizes, ends = [], [], []
        for x in batches:
            lists = x.column(1)
            owner.append(x.column(0).to_numpy().copy())
            sizes.append(np.diff(lists.offsets.to_numpy()))
            ends.append(lists.flatten().to_numpy().copy())
        if not owner:
            return
        ids, at = np.unique(np.concatenate(owner), return_inverse=True)
        degree = np.bincount(at, weights=np.concatenate(sizes))
        for i, x in enumerate(ends):
            ends[i] = np.searchsorted(ids, x).astype(np.int32)
        links = np.concatenate(ends)  # lists come in the order of a
        ends.clear()
        first = np.concatenate([[0], np.cumsum(degree).astype(np.int64)]).tolist()
        of, weight = np.arange(len(ids)), degree.copy()  # weight: by community, kept as vertices move
        for _ in range(iterations):
            moved = False
            for v in range(len(ids)):
                c, inside = np.unique(of[links[first[v] : first[v + 1]]], return_counts=True)
                gains = inside - degree[v] * weight[c] / total
                i = gains.argmax()  # the smallest community of equals
                if gains[i] > 0 and c[i] != of[v]:
                    weight[of[v]] -= degree[v]
                    weight[c[i]] += degree[v]
                    of[v], moved = c[i], True
            if not moved:
                break
        for i in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(ids[of[i : i + (1 << 16)]])], names=["id", "label"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(tasks, "component").sortWithinPartitions("a").select("a", "near").mapInArrow(moves, "id bigint, label bigint")
    state = g.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return _renumbered(materialize(state, "louvain"), "label")


# ---- temporal

def _timed(g: Projection, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    if start > end:
        raise AnalyticsError("INVALID-REQUEST", "the window ends before it starts")
    e = g.edges.select("id", "src", "dst", F.col(departure).alias("dep"), F.col(arrival).alias("arr"))
    if not e.where(F.col("dep").isNull() | F.col("arr").isNull()).isEmpty():
        raise AnalyticsError("MISSING-PROPERTY", "an edge has no departure or arrival")
    return e


def _extremes(g: Projection, at: int, e: DataFrame, begin: int, forward: bool) -> DataFrame:
    """vertex, t: the earliest arrival from a vertex (forward), or the latest departure towards it."""
    near, far, leave, reach = ("src", "dst", "dep", "arr") if forward else ("dst", "src", "arr", "dep")
    best = frontier = both = materialize(g.vertices.where(F.col("id") == at).select(F.col("id").alias("vertex"), F.lit(begin).cast("bigint").alias("t")).distinct(), "timed")
    for n in count(1):
        g.round(n)
        usable = F.col(leave) >= F.col("t") if forward else F.col(leave) <= F.col("t")
        found = frontier.join(e, F.col("vertex") == F.col(near)).where(usable)
        found = found.groupBy(F.col(far).alias("vertex")).agg((F.min if forward else F.max)(reach).alias("new"))
        met = best.join(found, "vertex", "full_outer")
        better = F.col("new") < F.col("t") if forward else F.col("new") > F.col("t")
        met = met.select("vertex", (F.least if forward else F.greatest)("t", "new").alias("t"), (F.col("t").isNull() | better).alias("changed"))
        old, both = both, materialize(met, "timed")
        release(old)
        best, frontier = both.drop("changed"), both.where("changed").drop("changed")
        if frontier.isEmpty():
            return best


def _usable(g: Projection, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    e = _timed(g, departure, arrival, start, end)
    return materialize(e.where((F.col("dep") >= start) & (F.col("arr") >= F.col("dep")) & (F.col("arr") <= end)), "timed")


def arrival_times(g: Projection, source: int, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    """vertex, arrival_time: the earliest arrivals of time-respecting walks in the window."""
    g.has(source)
    return _extremes(g, source, _usable(g, departure, arrival, start, end), start, True).select("vertex", F.col("t").alias("arrival_time"))


def departure_times(g: Projection, target: int, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    """vertex, departure_time: the latest departures that still reach target in the window."""
    g.has(target)
    return _extremes(g, target, _usable(g, departure, arrival, start, end), end, False).select("vertex", F.col("t").alias("departure_time"))


def temporal_reachability(g: Projection, source: int, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    return arrival_times(g, source, departure, arrival, start, end).select("vertex")


_PATH = "position bigint, vertex bigint, edge_id bigint, departure_time bigint, arrival_time bigint"


def _timed_path(g: Projection, here: int, there: int, departure: str, arrival: str, start: int, end: int, forward: bool) -> DataFrame:
    """The best path from here to there, or against time from there's point of view; fewest edges among equals, then the smallest neighbours.

    Only edges that are tight, that is leave no earlier and arrive exactly at their ends' best times,
    can lie on it. They are layered from here, then followed back from there.
    """
    g.has(here)
    g.has(there)
    spark = g.edges.sparkSession
    e = _usable(g, departure, arrival, start, end)
    best = _extremes(g, here, e, start if forward else end, forward)
    row = best.where(F.col("vertex") == there).first()
    if row is None:
        return spark.createDataFrame([], _PATH)
    near, far = ("src", "dst") if forward else ("dst", "src")
    t = best.select(F.col("vertex").alias(near), F.col("t").alias("tn"))
    u = best.select(F.col("vertex").alias(far), F.col("t").alias("tf"))
    fits = (F.col("dep") >= F.col("tn")) & (F.col("arr") == F.col("tf")) if forward else (F.col("arr") <= F.col("tn")) & (F.col("dep") == F.col("tf"))
    tight = materialize(e.join(t, near).join(u, far).where(fits).select("id", "dep", "arr", F.col(near).alias("a"), F.col(far).alias("b")), "tight")
    layers = [spark.createDataFrame([(here,)], "vertex bigint")]
    seen = layers[0]
    while layers[-1].where(F.col("vertex") == there).isEmpty():
        new = tight.join(layers[-1], F.col("a") == F.col("vertex")).select(F.col("b").alias("vertex")).distinct().join(seen, "vertex", "left_anti")
        layers.append(materialize(new, "tight"))
        seen = seen.unionByName(layers[-1])
    steps, at = [], there
    for layer in layers[-2::-1]:
        one = tight.where(F.col("b") == at).join(layer, F.col("a") == F.col("vertex")).orderBy("a", "id").first()
        steps.append(one)
        at = one["a"]
    if forward:
        steps = steps[::-1]
        vertices = [here, *(s["b"] for s in steps)]
    else:
        vertices = [there, *(s["a"] for s in steps)]
    first = steps[0]["dep"] if steps else row["t"]
    last = steps[-1]["arr"] if steps else row["t"]
    rows = [(i, v, steps[i - 1]["id"] if i else None, first, last) for i, v in enumerate(vertices)]
    return spark.createDataFrame(rows, _PATH)


def earliest_arrival(g: Projection, source: int, target: int, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    """The path of earliest arrival, or no rows."""
    return _timed_path(g, source, target, departure, arrival, start, end, True)


def latest_departure(g: Projection, source: int, target: int, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    """The path of latest departure, or no rows."""
    return _timed_path(g, target, source, departure, arrival, start, end, False)


def temporal_motif(g: Projection, departure: str, arrival: str, start: int, end: int) -> DataFrame:
    """count of two-edge walks whose second edge departs at or after the first one's arrival.

    No walks are listed: per middle vertex, first edges are counted by arrival and met by second
    edges through a running sum over the times.
    """
    e = _timed(g, departure, arrival, start, end)
    first = e.where((F.col("dep") >= start) & (F.col("arr") >= F.col("dep")) & (F.col("arr") <= end)).groupBy(F.col("dst").alias("m"), F.col("arr").alias("t")).agg(F.count("*").alias("ins"), F.lit(0).cast("bigint").alias("outs"))
    second = e.where(F.col("arr") <= end).groupBy(F.col("src").alias("m"), F.col("dep").alias("t")).agg(F.lit(0).cast("bigint").alias("ins"), F.count("*").alias("outs"))
    both = first.unionByName(second).groupBy("m", "t").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
    both = temporal.running(both, "m", ["t"], "before", F.col("ins"), "sum", inclusive=True)
    return both.agg(F.coalesce(F.sum(F.col("before") * F.col("outs")), F.lit(0)).cast("bigint").alias("count"))


def change_point(g: Projection, event_time: str, signal: str, threshold: float = 0.0) -> DataFrame:
    """position, edge_id where the signal differs from the one before, in order of (time, id), by threshold or more.

    The order is cut in ranges; each range's first row is compared with the last one before it.
    """
    if not (math.isfinite(threshold) and threshold >= 0):
        raise AnalyticsError("INVALID-REQUEST", "the threshold must be finite and not negative")
    e = g.edges.select(F.col("id").alias("edge_id"), F.col(event_time).alias("t"), F.col(signal).cast("double").alias("s"))
    bad = e.agg(F.max((F.col("t").isNull() | F.col("s").isNull()).cast("int")), F.max((F.isnan("s") | (F.abs("s") == math.inf)).cast("int"))).first()
    if bad[0]:
        raise AnalyticsError("MISSING-PROPERTY", "an edge has no time or signal")
    if bad[1]:
        raise AnalyticsError("INVALID-PROPERTY", "a signal is not finite")
    rows = numbered(e, [F.col("t"), F.col("edge_id")], "i")
    block = F.floor(F.col("i") / 4096)
    rows = rows.withColumn("block", block)
    before = F.lag("s").over(W.partitionBy("block").orderBy("i"))
    ends = rows.where(F.col("i") % 4096 == 4095).select((F.col("block") + 1).alias("block"), F.col("s").alias("end"))
    rows = rows.withColumn("p", before).join(ends, "block", "left").withColumn("p", F.coalesce("p", "end"))
    hit = rows.where((F.abs(F.col("s") - F.col("p")) >= threshold) & (F.col("s") != F.col("p")))
    return numbered(hit.select("i", "edge_id"), [F.col("i")], "position").select("position", "edge_id")


#: The closed list of algorithms, by name.
CATALOG = {f.__name__: f for f in (bfs, dfs, bounded_sssp, bounded_apsp, strongly_connected_components, weakly_connected_components, page_rank, degree_centrality, closeness_centrality, betweenness_centrality, triangle_count, clustering_coefficient, k_core, label_propagation, louvain, earliest_arrival, latest_departure, temporal_reachability, temporal_motif, change_point)}


def run(name: str, g: Projection, **request) -> DataFrame:
    """Run an algorithm of the catalog on a graph that is checked first; unknown names are refused, and there are no others."""
    if name not in CATALOG:
        raise AnalyticsError("INVALID-REQUEST", f"unknown algorithm {name!r}")
    return CATALOG[name](g.check(), **request)
