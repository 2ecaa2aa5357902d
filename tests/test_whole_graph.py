"""The queries over all contacts against plain versions on the smallest tables."""

import heapq
import json
import math
from collections import Counter, defaultdict

import pytest

from tempora import queries
from tempora.operators import analytics
from tempora.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def contacts(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "props", "value").collect()
    edges = [(r.user_id + 1, int(json.loads(r.props)["k"]) + 1, r.value) for r in rows]
    return sorted({v for a, b, _ in edges for v in (a, b)}), edges


@pytest.fixture(scope="module")
def distances(contacts):
    vertices, edges = contacts
    out = defaultdict(list)
    for a, b, w in edges:
        out[a].append((b, w))
    found = {}
    for s in vertices:
        done, heap = {}, [(0.0, s)]
        while heap:
            x, v = heapq.heappop(heap)
            if v not in done:
                done[v] = x
                for u, w in out[v]:
                    heapq.heappush(heap, (x + w, u))
        found[s] = done
    return found


def hops(vertices, edges, s):
    """Depths, numbers of shortest paths (parallel edges multiply), order and predecessors."""
    out = defaultdict(Counter)
    for a, b, _ in edges:
        out[a][b] += 1
    dist, paths, order, pred = {s: 0}, Counter({s: 1}), [s], defaultdict(list)
    for v in order:
        for u, k in out[v].items():
            if u not in dist:
                dist[u] = dist[v] + 1
                order.append(u)
            if dist[u] == dist[v] + 1:
                paths[u] += paths[v] * k
                pred[u].append((v, k))
    return dist, paths, order, pred


def test_paths(spark, distances):
    got = {r.vertex: r.distance for r in QUERIES["ga_sssp"](spark, SF).collect()}
    assert got.keys() == distances[3].keys() and all(math.isclose(got[v], x, abs_tol=1e-5) for v, x in distances[3].items())
    got = {(r.source, r.target): r.distance for r in QUERIES["ga_apsp"](spark, SF).collect()}
    want = {(s, v): x for s, d in distances.items() for v, x in d.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], x, abs_tol=1e-5) for k, x in want.items())


def test_components(spark, contacts, distances):
    got = {r.vertex: r.component for r in QUERIES["ga_scc"](spark, SF).collect()}
    assert got == {v: min(u for u in distances[v] if v in distances[u]) for v in contacts[0]}


def test_centrality(spark, contacts):
    vertices, edges = contacts
    close, between = dict.fromkeys(vertices, 0.0), dict.fromkeys(vertices, 0.0)
    for s in vertices:
        dist, paths, order, pred = hops(vertices, edges, s)
        total, n = sum(dist.values()), len(dist) - 1
        close[s] = n * n / ((len(vertices) - 1) * total) if total else 0.0
        dep = Counter()
        for v in reversed(order):
            for u, k in pred[v]:
                dep[u] += paths[u] * k / paths[v] * (1 + dep[v])
            if v != s:
                between[v] += dep[v]
    whole = queries.contacts(spark, SF)
    for scored, want in ((analytics.closeness_centrality, close), (analytics.betweenness_centrality, between)):  # the queries round what these give
        got = {r.vertex: r.score for r in scored(whole).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[v], x, abs_tol=1e-5) for v, x in want.items())
