"""What steps write and hold stays in proportion to the graph, and results are the plain versions' still."""

import heapq
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tempora.functions import components as stars
from tempora.operators import analytics as A

N = 60


@pytest.fixture(scope="module")
def fan():
    """A ring with chords of vertices 1 to 6, which edges of 7 to 58 enter: parallel ones, loops, and 59 and 60 without edges."""
    rng = random.Random(3)
    edges = [(i, i % 6 + 1, 1.0) for i in range(1, 7)] + [(1, 4, 1.5), (4, 2, 0.25), (2, 2, 1.0)]
    edges += [(s, rng.randint(1, 6), rng.randint(0, 9) / 4) for s in range(7, 59) for _ in range(rng.randint(1, 4))]
    return edges + [(7, 7, 0.5), (7, 1, 3.0), (7, 1, 3.0)]


@pytest.fixture()
def graph(spark, fan):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(fan)], "id bigint, src bigint, dst bigint, weight double")
    return A.Projection(spark.range(1, N + 1), e)


@pytest.fixture()
def written(monkeypatch):
    """The most rows that were written under each name."""
    most, real = Counter(), A.materialize

    def counted(df, name):
        out = real(df, name)
        most[name] = max(most[name], out.count())
        return out

    monkeypatch.setattr(A, "materialize", counted)
    return most


def plain(fan, weight):
    """Least distances by source."""
    out, found = defaultdict(list), {}
    for a, b, w in fan:
        out[a].append((b, w if weight else 1))
    for s in range(1, N + 1):
        done, heap = {}, [(0, s)]
        while heap:
            x, v = heapq.heappop(heap)
            if v not in done:
                done[v] = x
                for u, w in out[v]:
                    heapq.heappush(heap, (x + w, u))
        found[s] = done
    return found


@pytest.mark.parametrize("small", [1 << 20, 1])
def test_apsp_rounds_leave_out_sources_that_nothing_enters(graph, fan, written, monkeypatch, small):
    monkeypatch.setattr(A, "SMALL", small)
    got = {(r.source, r.target): r.distance for r in A.bounded_apsp(graph, "weight", N * N).collect()}
    assert got == {(s, v): x for s, d in plain(fan, True).items() for v, x in d.items()}
    assert written["relax"] <= 36
    with pytest.raises(A.AnalyticsError, match="MISSING-PROPERTY"):  # of an edge that no round goes over
        A.bounded_apsp(A.Projection(graph.vertices, graph.edges.withColumn("weight", F.when(F.col("src") != 58, F.col("weight")))), "weight", N * N)


def shortest(fan, s):
    """Order, numbers of shortest paths and what comes before each vertex, with how many edges."""
    out, dist, paths, order, before = defaultdict(Counter), {s: 0}, Counter({s: 1}), [s], defaultdict(list)
    for a, b, _ in fan:
        out[a][b] += 1
    for v in order:
        for u, k in out[v].items():
            if u not in dist:
                dist[u] = dist[v] + 1
                order.append(u)
            if dist[u] == dist[v] + 1:
                paths[u] += paths[v] * k
                before[u].append((v, k))
    return order, paths, before


@pytest.mark.parametrize("square", [1 << 10, 1])
def test_betweenness_writes_no_pairs_of_sources_that_nothing_enters(graph, fan, written, monkeypatch, square):
    monkeypatch.setattr(A, "SQUARE", square)
    want = dict.fromkeys(range(1, N + 1), 0.0)
    for s in want:
        (order, paths, before), share = shortest(fan, s), Counter()
        for v in reversed(order):
            for u, k in before[v]:
                share[u] += paths[u] * k / paths[v] * (1 + share[v])
            want[v] += share[v] if v != s else 0.0
    got = {r.vertex: r.score for r in A.betweenness_centrality(graph).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[v], x, abs_tol=1e-9) for v, x in want.items())
    if square > 1:
        assert written["hops"] <= 36


def test_closeness_writes_no_pairs_of_sources_that_nothing_enters(graph, fan, written):
    want = {}
    for s, d in plain(fan, False).items():
        want[s] = (len(d) - 1) ** 2 / ((N - 1) * sum(d.values())) if len(d) > 1 else 0.0
    got = {r.vertex: r.score for r in A.closeness_centrality(graph).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[v], x, abs_tol=1e-12) for v, x in want.items())
    assert written["hops"] <= 36


@pytest.mark.parametrize("hot", [1 << 18, 2])
def test_components_look_hot_nodes_up_in_a_broadcast_table(spark, monkeypatch, hot):
    monkeypatch.setattr(stars, "HOT", hot)
    rng = random.Random(7)
    edges = {(max(e), min(e)) for e in [(60, i) for i in range(1, 20)] + [(20, i) for i in range(21, 40)] + [(rng.randint(40, 59), rng.randint(40, 59)) for _ in range(15)] if e[0] != e[1]}
    least = {v: v for e in edges for v in e}
    for _ in range(60):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = {r.u: r.v for r in stars.components(spark.createDataFrame(sorted(edges), "u bigint, v bigint")).collect()}
    assert got == {v: x for v, x in least.items() if v != x}


@pytest.mark.parametrize("small", [1 << 20, 16])
def test_clustering_deals_pairs_to_as_many_tasks_as_they_need(graph, fan, monkeypatch, small):
    monkeypatch.setattr(A, "SMALL", small)
    near = defaultdict(set)
    for a, b, _ in fan:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {v: sum(u in near[x] for u in near[v] for x in near[v]) / max(1, len(near[v]) * (len(near[v]) - 1)) for v in range(1, N + 1)}
    got = {r.vertex: r.score for r in A.clustering_coefficient(graph).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[v], x, abs_tol=1e-12) for v, x in want.items())
    assert A._undirected(graph).rdd.getNumPartitions() == -(-2 * len(fan) // small)


def test_louvain_holds_lists_of_bounded_length(spark, monkeypatch):
    """Against a plain sequence, on components of which one has a hub with links in several lists."""
    rng, given, real = random.Random(9), [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: (given.append(df.agg(F.max(F.size("near"))).first()[0]) if "near" in df.columns else None) or real(df, name))
    pairs = {(1, v) for v in range(2, 1500)} | {(v, rng.randint(2, 1499)) for v in range(2, 1500)} | {(v, rng.randint(2000, 2020)) for v in range(2000, 2020)}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(sorted(pairs))], "id bigint, src bigint, dst bigint")
    got = {r.vertex: r.community for r in A.louvain(A.Projection(spark.range(1, 2022), e), 8).collect()}
    of, total = {v: v for v in range(1, 2022)}, sum(map(len, near.values()))
    weight = Counter({v: len(x) for v, x in near.items()})
    for _ in range(8):
        moved = False
        for v in sorted(near):
            gain, c = min((-(w - len(near[v]) * weight[c] / total), c) for c, w in Counter(of[u] for u in near[v]).items())
            if c != of[v] and gain < 0:
                weight[of[v]] -= len(near[v])
                weight[c] += len(near[v])
                of[v], moved = c, True
        if not moved:
            break
    ids = {c: i for i, c in enumerate(sorted(set(of.values())), 1)}
    assert got == {v: ids[c] for v, c in of.items()}
    assert len(given) == 1 and given[0] <= 1024
