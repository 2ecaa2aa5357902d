import pytest
from pyspark.sql import functions as F

from tempora.model import OPEN, Graph, PropertySpec
from tempora.operators import temporal
from tempora.operators.write import GraphWriter, TransactionError
from tempora.plans import ir
from tempora.plans.language import LanguageError
from tempora.session import GraphSession

V = "id bigint, version bigint, valid_from bigint, valid_to bigint, tx_time bigint, tombstone boolean, log_index bigint, ordinal bigint, labels array<string>, score bigint"
E = "id bigint, version bigint, valid_from bigint, valid_to bigint, tx_time bigint, tombstone boolean, log_index bigint, ordinal bigint, src bigint, dst bigint, edge_type string"


def put(i, score, version=1, a=0, b=100, tx=10, labels=("User",), log=1):
    return (i, version, a, b, tx, False, log, i, list(labels), score)


def edge(i, s, d, version=1, a=0, b=100, tx=10, kind="KNOWS"):
    return (i, version, a, b, tx, False, 1, i, s, d, kind)


@pytest.fixture(scope="module")
def session(spark):
    vs = [put(1, 5), put(2, 7), put(3, None), put(2, 9, version=2, tx=20), (4, 1, 0, 100, 10, False, 1, 4, ["User"], 1), (4, 2, None, None, 12, True, 2, 4, None, None), put(5, 1, a=50), put(6, 2, labels=("Bot",))]
    es = [edge(7, 1, 2), edge(8, 2, 3), edge(9, 3, 1), edge(10, 1, 1), edge(11, 1, 2, kind="LIKES")]
    g = Graph(spark.createDataFrame(vs, V), spark.createDataFrame(es, E), [PropertySpec("score", "integer")], [])
    return GraphSession(spark, g)


def run(session, text, params=None, valid_at=17, tx_at=23):
    return [tuple(r) for r in session.query(text, params, valid_at, tx_at).collect()]


def test_visibility(session):
    assert run(session, "MATCH (n) RETURN n.id, n.score ORDER BY n.id") == [(1, 5), (2, 9), (3, None), (6, 2)]
    assert run(session, "MATCH (n) FOR SYSTEM_TIME AS OF 11 RETURN n.id, n.score ORDER BY n.id") == [(1, 5), (2, 7), (3, None), (4, 1), (6, 2)]
    assert run(session, "MATCH (n) FOR VALID_TIME AS OF 60 RETURN COUNT(*)") == [(5,)]
    assert run(session, "MATCH (n) WHERE n.id = $id RETURN n.score", {"id": 2}) == [(9,)]
    assert run(session, "MATCH (n:Bot) RETURN n.id") == [(6,)]
    assert run(session, "MATCH (n {score: 9}) RETURN n.id") == [(2,)]
    assert run(session, "MATCH (n) WHERE n.score = '9' RETURN n.id") == []
    assert run(session, "CHANGES FOR SYSTEM_TIME BETWEEN 11 AND 30 MATCH (n) RETURN n.id, n.change_kind ORDER BY n.id") == [(2, "put"), (4, "delete")]
    assert run(session, "MATCH (n) FOR VALID_TIME BETWEEN 40 AND 60 RETURN COUNT(*)") == [(5,)]


def test_ties_on_time_and_version(spark):
    rows = [put(1, 5, log=3), (1, 1, None, None, 10, True, 2, 0, None, None), put(1, 6, log=4)]
    assert [r.score for r in temporal.visible(spark.createDataFrame(rows, V), 17, 23).collect()] == [5]


def test_patterns(session):
    assert sorted(run(session, "MATCH (a)-[r:KNOWS]->(b) RETURN a.id, b.id")) == [(1, 1), (1, 2), (2, 3), (3, 1)]
    assert sorted(run(session, "MATCH (a)<-[r:LIKES]-(b) RETURN a.id, b.id")) == [(2, 1)]
    assert len(run(session, "MATCH (a)-[r]-(b) WHERE a.id = 1 RETURN r")) == 4
    assert sorted(run(session, "MATCH (a)-[]->(b)-[]->(c) WHERE a.id = 1 RETURN b.id, c.id")) == [(1, 1), (1, 2), (1, 2), (2, 3), (2, 3)]
    assert sorted(run(session, "MATCH (a)-[r:KNOWS]->(b) MATCH (b)-[s:KNOWS]->(c) RETURN a.id, c.id")) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)]
    assert sorted(run(session, "MATCH (a) MATCH (b) WHERE a.score = b.id RETURN a.id, b.id")) == [(6, 2)]
    row = session.query("MATCH (a)-[r]->(b) WHERE a.id = 2 RETURN r, a", None, 17, 23).first()
    assert row.r.source == 2 and row.r.target == 3 and row.r.type == "KNOWS" and row.a.id == 2


def test_plans(session):
    n = ir.NodeScan("n")
    prop = lambda v, p: ir.Property(ir.Variable(v), p)
    go = lambda p: [tuple(r) for r in session.plan(p, snapshot=__import__("tempora.plans.lower", fromlist=["Snapshot"]).Snapshot(17, 23)).collect()]
    out = ir.Aggregate(n, ((ir.Binary(">", prop("n", "score"), ir.Literal(4)), "big"),), (ir.AggregateCall("count", None, "c"), ir.AggregateCall("sum", prop("n", "score"), "s"), ir.AggregateCall("collect", prop("n", "score"), "l")))
    assert sorted(go(out), key=str) == sorted([(True, 2, 14, [5, 9]), (False, 1, 2, [2]), (None, 1, None, [])], key=str)
    key = ir.Sort(ir.Project(n, ((prop("n", "id"), "i"), (prop("n", "score"), "s"))), ((ir.Variable("s"), False),))
    assert go(key) == [(3, None), (6, 2), (1, 5), (2, 9)]
    assert go(ir.Limit(key, 1, 2)) == [(6, 2), (1, 5)]
    left, right = ir.Project(n, ((prop("n", "id"), "i"), (prop("n", "score"), "s"))), ir.Project(ir.NodeScan("m"), ((prop("m", "id"), "j"), (prop("m", "score"), "t")))
    eq = ir.Binary("=", ir.Variable("s"), ir.Variable("t"))
    assert len(go(ir.Join(left, right, "inner", eq))) == 4  # NULL meets NULL
    assert len(go(ir.Join(left, right, "left_anti", ir.Binary("=", ir.Variable("i"), ir.Variable("t"))))) == 3
    un = ir.Unwind(ir.VertexLookup("n", ir.Literal(1)), ir.ListOf((ir.Literal(1), ir.Literal(2))), "x")
    assert go(ir.Project(un, ((ir.Binary("+", ir.Variable("x"), prop("n", "score")), "y"),))) == [(6,), (7,)]
    assert go(ir.Project(ir.VertexLookup("n", ir.Literal(1)), ((ir.Binary("/", ir.Literal(-7), ir.Literal(2)), "d"), (ir.Binary("contains", ir.Literal("abc"), ir.Literal("b")), "c"), (ir.Binary("<", ir.Literal(9), ir.Literal("a")), "o")))) == [(-3, True, True)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        go(ir.Project(ir.VertexLookup("n", ir.Literal(1)), ((ir.Binary("/", prop("n", "id"), ir.Binary("-", prop("n", "id"), ir.Literal(1))), "d"),)))


def test_islands_and_overlay(spark):
    v = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 30), (2, 0, 50)], "id bigint, valid_from bigint, valid_to bigint")
    e = spark.createDataFrame([(7, 1, 1, 2, 5, 18), (8, 1, 1, 2, 5, 22)], "id bigint, version bigint, src bigint, dst bigint, valid_from bigint, valid_to bigint")
    assert {r.id: r.covered for r in temporal.covered(e, v).collect()} == {7: True, 8: False}
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, x string")
    staged = spark.createDataFrame([(1, "z", 0, 100, False, 0), (2, None, None, None, True, 1), (4, "n", 0, 100, False, 2), (1, "y", 0, 100, False, 3), (3, "q", 50, 100, False, 4)], "id bigint, x string, valid_from bigint, valid_to bigint, tombstone boolean, ordinal bigint")
    assert sorted(map(tuple, temporal.overlay(base, staged, 17).collect())) == [(1, "y"), (3, "c"), (4, "n")]


def test_writes(spark, tmp_path):
    w = GraphWriter(spark, f"file://{tmp_path}/g", [PropertySpec("name", "string"), PropertySpec("value", "integer")], [PropertySpec("since", "integer")])
    s = GraphSession(spark).attach_writer(w)
    s.query("CREATE (n:Bench {name: 'a', value: 1}) VALID FROM 5")
    s.query("CREATE (n:Bench {name: 'b', value: 2}) VALID FROM 5")
    assert sorted(map(tuple, s.query("MATCH (n:Bench) RETURN n.name, n.value").collect())) == [("a", 1), ("b", 2)]
    s.query("MATCH (a {name: 'a'}) MATCH (b {name: 'b'}) CREATE (a)-[r:KNOWS {since: $y}]->(b) VALID FROM 7", {"y": 3})
    assert [tuple(r) for r in s.query("MATCH (a)-[r]->(b) RETURN a.name, r.since, b.name").collect()] == [("a", 3, "b")]
    s.query("MATCH (a {name: 'a'}) SET a.value = 9 VALID FROM 6")
    assert [r[0] for r in s.query("MATCH (a {name: 'a'}) RETURN a.value").collect()] == [9]
    assert [r[0] for r in s.query("MATCH (a {name: 'a'}) RETURN a.value", valid_at=5).collect()] == [1]
    with pytest.raises(TransactionError, match="COVERAGE"):
        s.query("MATCH (a {name: 'a'}) MATCH (b {name: 'b'}) CREATE (a)-[r:KNOWS]->(b) VALID FROM 1")
    s.query("BEGIN")
    s.query("MATCH (b {name: 'b'}) DELETE b VALID FROM 8")
    with pytest.raises(TransactionError, match="COVERAGE"):
        s.query("COMMIT")  # an edge still needs it
    s.query("BEGIN")
    s.query("MATCH (a)-[r]->(b) DELETE r VALID FROM 8")
    s.query("MATCH (b {name: 'b'}) DELETE b VALID FROM 8")
    assert s.query("MATCH (n) RETURN COUNT(*)").first()[0] == 2
    s.query("COMMIT")
    assert s.query("MATCH (n) RETURN COUNT(*)").first()[0] == 1
    with pytest.raises(LanguageError, match="TRANSACTION"):
        s.query("COMMIT")
    start = w.manifest()["tx_time"]
    row = lambda v: [w.rows("vertex", spark.createDataFrame([(77, v, 0, OPEN, "x")], "id bigint, version bigint, valid_from bigint, valid_to bigint, name string"))]
    w.commit(row(1), start, key="k1")
    assert w.commit(row(1), start, key="k1")["replayed"]
    with pytest.raises(TransactionError, match="CONFLICT"):
        w.commit(row(2), start)
    with pytest.raises(TransactionError, match="DUPLICATE-VERSION"):
        w.commit(row(3) + row(3))
    with pytest.raises(TransactionError, match="PROPERTY"):
        s.query("CREATE (n {unknown: 1}) VALID FROM 1")


def test_snapshots_stream_and_jobs(spark, tmp_path, session):
    from tempora.operators.analytics import Projection
    from tempora.sources.store import StoreSource, export_snapshot, import_snapshot
    from tempora.streaming.ingest import Ingest
    from tempora.streaming.jobs import Jobs

    export_snapshot(session.default, f"file://{tmp_path}/snap")
    g = import_snapshot(spark, f"file://{tmp_path}/snap", session.default.vertex_properties, [])
    assert g.vertices.count() == session.default.vertices.count()
    spark.createDataFrame([(1,)], "x int").write.mode("append").parquet(f"file://{tmp_path}/snap/edge")
    with pytest.raises(ValueError, match="differs"):
        import_snapshot(spark, f"file://{tmp_path}/snap", session.default.vertex_properties, [])
    w = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string")], [])
    ingest = Ingest(w, f"file://{tmp_path}/receipts")
    src = f"{tmp_path}/in"
    schema = "item_key string, id bigint, valid_from bigint, name string"
    spark.createDataFrame([("a", 1, 0, "x"), ("b", 2, 0, "y"), ("a", 1, 0, "x")], schema).write.parquet(f"{src}/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    ingest.start(stream, f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", 1, 0, "x"), ("b", 2, 0, "other"), ("c", 3, 0, "z")], schema).write.parquet(f"{src}/2")
    ingest.start(stream, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in w.graph().vertices.collect()) == [1, 2, 3]
    got = {(r.item_key, r.batch_id): r.status for r in ingest.receipts().collect()}
    assert got == {("a", 0): "COMMITTED", ("b", 0): "COMMITTED", ("a", 1): "COMMITTED", ("b", 1): "REJECTED", ("c", 1): "COMMITTED"}
    ingest.batch(spark.read.schema(schema).parquet(f"{src}/1"), 0)
    assert w.graph().vertices.count() == 3
    e = spark.createDataFrame([(1, 1, 2)], "id bigint, src bigint, dst bigint")
    jobs = Jobs(spark, f"file://{tmp_path}/jobs")
    jobs.submit("r1", "degree_centrality", Projection(spark.createDataFrame([(1,), (2,)], "id bigint"), e))
    jobs.submit("r1", "degree_centrality", Projection(spark.createDataFrame([(1,), (2,)], "id bigint"), e))
    assert jobs.result("r1", 120).count() == 2 and jobs.status("r1") == "SUCCEEDED"
    spark.dataSource.register(StoreSource)
    files = [f"{tmp_path}/in/1/{f}" for f in __import__("os").listdir(f"{src}/1") if f.endswith(".parquet")]
    assert spark.read.format("tempora").option("paths", ",".join(files)).load().count() == 3


def test_a_large_batch_is_one_commit(spark, tmp_path, monkeypatch):
    from tempora.streaming import ingest

    w = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string")], [])
    items = spark.range(1, 5001).selectExpr("cast(id as string) item_key", "id", "0L valid_from", "'x' name")
    for _ in range(2):
        ingest.Ingest(w, f"file://{tmp_path}/r").batch(items, 0)
    assert w.manifest()["number"] == 1 and w.graph().vertices.count() == 5000
    with pytest.raises(TransactionError, match="LIMIT"):
        w.commit([w.rows("vertex", items.selectExpr("id + 9000 as id", "valid_from", "5L as valid_to"))])
    again = ingest.Ingest(w, f"file://{tmp_path}/r")
    again.batch(items.where("id <= 3").selectExpr("concat('n', id) item_key", "id", "9L valid_from", "'y' name"), 1)
    assert sorted((r.id, r.version) for r in w.graph().vertices.where("name = 'y'").collect()) == [(1, 2), (2, 2), (3, 2)]


def test_change_feed_follows_the_committed_log(spark, tmp_path):
    from tempora.streaming.ingest import ChangeFeed

    w = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string")], [])
    put = lambda *ids, v=1: [w.rows("vertex", spark.createDataFrame([(i, v, v * 10, OPEN, "x") for i in ids], "id bigint, version bigint, valid_from bigint, valid_to bigint, name string"))]
    feed, seen = ChangeFeed(w), []

    def follow():
        feed.start(lambda df, _: seen.extend((r.log_index, r.ordinal, r.id, r.change_kind) for r in df.orderBy("log_index", "ordinal").collect()), f"{tmp_path}/cp").awaitTermination()

    def streamed():
        q = feed.stream("vertex").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.id, r.version) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    w.commit(put(1, 2))
    follow()
    w.commit(put(3))
    w.compact()
    follow()
    other, number = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string")], []), w.manifest()["number"]
    stale = other.manifest()
    other.manifest = lambda: stale  # a writer that has not seen the next commit
    w.commit(put(4))
    with pytest.raises(TransactionError, match="CONFLICT"):
        other.commit(put(5))
    assert w.manifest()["number"] == number + 1
    w.compact()
    w.commit(put(1, v=2))
    follow()
    assert [x[2] for x in seen] == [1, 2, 3, 4, 1] and seen == sorted(set(seen))
    assert streamed() == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)]
    assert [r.id for r in feed.changes(None, 2).collect()] == [1, 2] and [r.id for r in feed.changes((1, 1)).collect()] == [3, 4, 1]
    folders = sorted(w.folder.names("vertex"))
    assert set(folders) >= set(w.manifest()["batches"]["vertex"]) and len(spark.read.parquet(*[f"{tmp_path}/w/vertex/{f}" for f in folders]).where("id = 5").collect()) == 0
    log = temporal.change_log(w.graph().vertices, w.graph().edges)
    assert temporal.next_cursor(log, None, 99, 2) == (1, 1) and temporal.next_cursor(log, None, 99, 5) is None


def test_overlay_checks(spark, tmp_path):
    w = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string")], [])
    v = lambda *rows: w.rows("vertex", spark.createDataFrame(rows, "id bigint, version bigint, valid_from bigint, valid_to bigint, tombstone boolean"))
    e = lambda *rows: w.rows("edge", spark.createDataFrame(rows, "id bigint, version bigint, valid_from bigint, valid_to bigint, tombstone boolean, src bigint, dst bigint, edge_type string"))
    w.commit([v((1, 1, 0, 100, False), (2, 1, 0, 100, False), (3, 1, 0, 100, False)), e((9, 1, 5, 50, False, 1, 2, "A"))])
    for fault, batch in (
        ("DUPLICATE-VERSION", [v((1, 1, 0, 100, False))]),
        ("PUT-AND-DELETE", [v((3, 2, 0, 100, False), (3, 3, None, None, True))]),
        ("OVERLAPPING", [v((4, 1, 0, 100, False), (4, 2, 50, 150, False))]),
        ("ENDPOINTS", [e((9, 2, 5, 50, False, 1, 3, "A"))]),
        ("ENDPOINTS", [e((9, 2, 5, 50, False, 1, 2, "B"))]),
        ("COVERAGE", [e((10, 1, 5, 101, False, 1, 2, "A"))]),
        ("COVERAGE", [v((2, 2, None, None, True))]),
        ("COVERAGE", [v((3, 2, None, None, True)), e((10, 1, 5, 50, False, 1, 3, "A"))]),
    ):
        with pytest.raises(TransactionError, match=fault):
            w.commit(batch)
    w.commit([v((3, 2, None, None, True))])
    with pytest.raises(TransactionError, match="COVERAGE"):
        w.commit([e((10, 1, 5, 50, False, 1, 3, "A"))])  # to a vertex that was deleted before
    w.commit([v((3, 3, 0, 60, False)), e((10, 1, 5, 50, False, 1, 3, "A"))])
    w.commit([v((2, 2, None, None, True)), e((9, 2, None, None, True, 1, 2, "A"))])
    w.commit([e((9, 3, 5, 50, False, 1, 3, "B"))])  # after its delete an identity may start anew
    assert w.manifest()["number"] == 5


def test_keys_of_commits_whose_writer_died(spark, tmp_path):
    w = GraphWriter(spark, f"file://{tmp_path}/w", [], [])
    row = lambda i: [w.rows("vertex", spark.createDataFrame([(i, 0, 9)], "id bigint, valid_from bigint, valid_to bigint"))]
    w.commit(row(1), key="a")
    w.folder.remove("keys")  # the manifest was published, the key's file was not
    assert w.commit(row(1), key="a")["replayed"]
    w.commit(row(2), key="b")
    w.folder.remove(w._key_file("b"))
    w.compact()
    assert w.commit(row(2), key="b")["replayed"] and w.graph().vertices.count() == 2


def test_ends_reach_the_scan(spark, tmp_path):
    """One hop, and two, from a known vertex over a store: the filter on its end is pushed to the files, below the resolution."""
    w = GraphWriter(spark, f"file://{tmp_path}/w", [], [])
    n = 40
    v = spark.range(1, n + 1).selectExpr("id", "0L valid_from", "100L valid_to")
    e = spark.range(1, 10 * n + 1).selectExpr("id", "0L valid_from", "100L valid_to", f"id % {n} + 1 as src", f"id * 7 % {n} + 1 as dst", "'T' as edge_type")
    w.commit([w.rows("vertex", v), w.rows("edge", e)])
    s = GraphSession(spark, w.graph())
    one = s.query("MATCH (a)-[r:T]->(b) WHERE a.id = 3 RETURN r.id, b.id", None, 17)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Or(EqualTo(tombstone,true),EqualTo(src,3))" in plan and "Or(EqualTo(tombstone,true),EqualTo(edge_type,T))" in plan, plan
    links = [(i, i % n + 1, i * 7 % n + 1) for i in range(1, 10 * n + 1)]
    assert sorted(map(tuple, one.collect())) == sorted((i, b) for i, a, b in links if a == 3)
    two = s.query("MATCH (a)-[r]->(b)-[t]-(c) WHERE a.id = 3 RETURN r.id, t.id, c.id", None, 17)
    want = [(i, k, d if c == b else c) for i, a, b in links if a == 3 for k, c, d in links if b in (c, d)]
    assert sorted(map(tuple, two.collect())) == sorted(want)
    assert sorted(map(tuple, s.query("MATCH (a)<-[r]-(b) WHERE a.id = 3 RETURN r.id, b.id", None, 17).collect())) == sorted((i, a) for i, a, b in links if b == 3)


def test_pushdown(session, spark, tmp_path):
    session.default.vertices.write.parquet(f"{tmp_path}/v")
    plan = temporal.point(spark.read.parquet(f"{tmp_path}/v"), 2, 17, 23, [])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,2)" in plan and "score" not in plan
    assert F is not None
