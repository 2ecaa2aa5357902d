"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tempora.queries import QUERIES, SQL
from tempora.sources.tables import contacts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert canonical(got.columns, map(tuple, got.collect())) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    """Traversals, communities and paths: what holds of any right result."""
    edges = contacts(spark, SF)[1].select("id", "src", "dst").collect()
    vertices = {v for e in edges for v in (e.src, e.dst)}
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "ga_louvain":
        assert {r.vertex for r in rows} == vertices and {r.community for r in rows} == set(range(1, len({r.community for r in rows}) + 1))
    elif name == "ga_dfs":
        order = [r.vertex for r in sorted(rows, key=lambda r: r.position)]
        assert order[0] == 3 and len(set(order)) == len(order) and [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(len(rows)))
        assert all(any((e.src, e.dst) == (u, v) for e in edges for u in order[:i]) for i, v in enumerate(order) if i)
    else:
        ends = {e.id: (e.src, e.dst) for e in edges}
        path = sorted(rows, key=lambda r: r.position)
        assert path[0].vertex == 3 and all(ends[b.edge_id] == (a.vertex, b.vertex) for a, b in zip(path, path[1:]))
