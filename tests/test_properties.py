"""Generated histories and graphs against plain Python."""

from hypothesis import HealthCheck, given, settings, strategies as st

from tempora.model import OPEN
from tempora.operators import analytics, temporal

V = "id bigint, version bigint, valid_from bigint, valid_to bigint, tx_time bigint, tombstone boolean, log_index bigint, ordinal bigint, score bigint"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

small = st.integers(0, 6)
record = st.tuples(st.integers(1, 4), small, small, st.integers(1, 6), small, st.booleans(), st.integers(0, 50))


def rows(records):
    return [(i, v, None if dead else a, None if dead else a + n, tx, dead, k, 0, s) for k, (i, v, a, n, tx, dead, s) in enumerate(records)]


def seen(history, valid_at, tx_at):
    out = {}
    for r in history:
        i, version, a, b, tx, dead, log, ordinal, score = r
        if tx <= tx_at and (dead or a <= valid_at < b):
            key = (tx, version, not dead, -log, -ordinal)
            if i not in out or key > out[i][0]:
                out[i] = (key, dead, score)
    return {i: s for i, (_, dead, s) in out.items() if not dead}


@FEW
@given(st.lists(record, min_size=1, max_size=40), small, small)
def test_visibility(spark, records, valid_at, tx_at):
    h = rows(records)
    got = temporal.visible(spark.createDataFrame(h, V), valid_at, tx_at, ["score"]).collect()
    assert {r.id: r.score for r in got} == seen(h, valid_at, tx_at) and len(got) == len({r.id for r in got})


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), small, st.integers(1, 5)), min_size=1, max_size=25))
def test_islands(spark, intervals):
    df = spark.createDataFrame([(i, a, a + n) for i, a, n in intervals], "id bigint, valid_from bigint, valid_to bigint")
    got = {(i, t) for i, a, b in map(tuple, temporal.islands(df).collect()) for t in range(a, b)}
    assert got == {(i, t) for i, a, n in intervals for t in range(a, a + n)}
    spans = sorted(map(tuple, temporal.islands(df).collect()))
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(spans, spans[1:]))


def test_keys_of_any_size(spark, monkeypatch):
    """Running folds of hot keys, cut in ranges, equal those in one window; islands and counts that are made from them too."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), a := rng.randrange(400), a + rng.randint(1, 6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "id bigint, valid_from bigint, valid_to bigint").repartition(3)
    edges = spark.createDataFrame([(k, i, rng.choice([1, 1, 2]), a, b) for k, (i, a, b) in enumerate(rows)], "id bigint, src bigint, dst bigint, dep bigint, arr bigint")
    g = analytics.Projection(spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), edges)

    def results():
        folds = [sorted(map(str, temporal.running(df, "id", ["valid_from", "valid_to"], "x", F.col("valid_to"), f, inc).collect())) for f in ("max", "sum") for inc in (False, True)]
        return folds, sorted(map(tuple, temporal.islands(df).collect())), analytics.temporal_motif(g, "dep", "arr", 0, 500).first()[0]

    want = results()
    monkeypatch.setattr(temporal, "HOT", 5)
    assert results() == want


@FEW
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9)), min_size=1, max_size=14))
def test_weak_components(spark, pairs):
    e = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs, 1)], "id bigint, src bigint, dst bigint")
    g = analytics.Projection(spark.createDataFrame([(i,) for i in range(1, 10)], "id bigint"), e)
    of = {i: i for i in range(1, 10)}
    for _ in range(9):
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    assert {r.vertex: r.component for r in analytics.weakly_connected_components(g).collect()} == of


def test_open_end():
    assert OPEN == 2**63 - 1
