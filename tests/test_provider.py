"""The store as a provider, the data source over Parquet parts, snapshots put in place, a relational source."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains

from tempora.model import OPEN, PropertySpec
from tempora.operators.write import GraphWriter, TransactionError
from tempora.session import GraphSession
from tempora.sources import store
from tempora.sources.files import Folder
from tempora.sources.provider import Provider, ProviderError

NAME = [PropertySpec("name", "string")]


def put(spark, *rows):
    return [("vertex", spark.createDataFrame([(i, v, 0 if v == 1 else 50, 50 if v == 1 else OPEN, n) for i, v, n in rows], "id bigint, version bigint, valid_from bigint, valid_to bigint, name string"))]


def test_batches_come_in_order_and_once(spark, tmp_path):
    p = Provider(spark, f"file://{tmp_path}/p", NAME, [])
    assert p.handshake(1)["log_index"] == 0 and p.health()["ok"]
    with pytest.raises(ProviderError, match="VERSION"):
        p.handshake(2)
    one = put(spark, (1, 1, "a"), (2, 1, "b"))
    assert not p.apply(1, "c1", one)["replayed"] and p.apply(1, "c1", one)["replayed"]
    with pytest.raises(ProviderError, match="REUSED"):
        p.apply(2, "c1", put(spark, (3, 1, "c")))
    with pytest.raises(ProviderError, match="GAP"):
        p.apply(3, "c2", put(spark, (3, 1, "c")))
    p.apply(2, "c2", put(spark, (3, 1, "c")))
    p.folder.remove("keys")  # the driver died between the manifest and the key's file
    assert p.apply(2, "c2", put(spark, (3, 1, "c")))["replayed"]
    assert p.handshake(1)["log_index"] == 2 and p.writer.graph().vertices.count() == 3


def test_reads_are_pinned(spark, tmp_path):
    p = Provider(spark, f"file://{tmp_path}/p", NAME, [])
    before = p.begin_read()
    p.apply(1, "c1", put(spark, (1, 1, "a")))
    r = p.begin_read()
    p.apply(2, "c2", put(spark, (1, 2, "z"), (2, 1, "b")))
    p.writer.compact()
    assert p.writer.vacuum(through=99, grace=-1) != [] and p.health()["ok"]
    assert p.read(before, "vertex").count() == 0 and [x.name for x in p.read(r, "vertex").collect()] == ["a"]
    assert [x.id for x in p.changes(r).collect()] == [1]
    late = p.begin_read()
    assert [(x.id, x.name) for x in p.read(late, "vertex", 60, OPEN).collect()] == [(1, "z")]
    p.end_read(r)
    p.end_read(before)
    assert len(p.writer.vacuum(through=99, grace=-1)) == 1
    assert p.read(late, "vertex").count() == 3
    with pytest.raises(ProviderError, match="NO-READ"):
        p.read(r, "vertex")


def test_orphans_go_and_young_batches_stay(spark, tmp_path):
    w = GraphWriter(spark, f"file://{tmp_path}/w", NAME, [])
    w.commit([w.rows(*m) for m in put(spark, (1, 1, "a"))])
    spark.range(3).write.parquet(f"{tmp_path}/w/vertex/orphan")
    assert w.vacuum() == [] and w.vacuum(grace=-1) == ["vertex/orphan"]
    assert w.graph().vertices.count() == 1


def test_snapshots_move_a_store(spark, tmp_path):
    p = Provider(spark, f"file://{tmp_path}/p", NAME, [])
    p.apply(1, "c1", put(spark, (1, 1, "a")))
    p.apply(2, "c2", put(spark, (2, 1, "b")))
    p.export_snapshot(f"file://{tmp_path}/snap")
    p.apply(3, "c3", put(spark, (3, 1, "c")))
    staged = p.import_snapshot(f"file://{tmp_path}/snap", f"file://{tmp_path}/staged")
    with pytest.raises(ProviderError, match="DIFFERS"):
        p.import_snapshot(f"file://{tmp_path}/snap", f"file://{tmp_path}/staged")
    assert staged.handshake(1)["log_index"] == 2
    p.activate(staged)
    assert sorted(r.id for r in p.writer.graph().vertices.collect()) == [1, 2]
    p.apply(3, "c4", put(spark, (4, 1, "d")))
    assert [(r.log_index, r.id) for r in p.changes(p.begin_read()).collect()] == [(1, 1), (2, 2), (3, 4)]
    aside = [n for n in Folder(spark, f"file://{tmp_path}").names() if n.startswith("p.before-")]
    assert len(aside) == 1 and GraphWriter(spark, f"file://{tmp_path}/{aside[0]}", NAME, []).graph().vertices.count() == 3


def test_a_snapshot_is_put_in_place(spark, tmp_path):
    w = GraphWriter(spark, f"file://{tmp_path}/w", NAME, [])
    w.commit([w.rows(*m) for m in put(spark, (1, 1, "a"))])
    for n in ("one", "two"):
        store.export_snapshot(w.graph(), f"file://{tmp_path}/{n}")
        store.activate(spark, f"file://{tmp_path}/{n}", f"file://{tmp_path}/active")
    assert store.import_snapshot(spark, f"file://{tmp_path}/active", NAME, []).vertices.count() == 1
    with pytest.raises(ValueError, match="no manifest"):
        store.activate(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/active")


def test_one_writer_of_a_name_wins(spark, tmp_path):
    f = Folder(spark, f"file://{tmp_path}/f")
    for i in range(5):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda k: f.publish(f"{i}.json", {"k": k}), range(8)))
        assert sum(won) == 1 and f.read(f"{i}.json") == {"k": won.index(True)}
    assert f.names() == [f"{i}.json" for i in range(5)]


def test_source_answers_filters_and_takes_parts(spark, tmp_path):
    spark.dataSource.register(store.StoreSource)
    df = spark.range(100).withColumns({"s": F.concat(F.lit("k"), F.col("id") % 3), "x": F.when(F.col("id") % 2 == 0, F.col("id") / 2)})
    df.repartition(3).write.format("tempora").mode("append").save(f"{tmp_path}/parts")
    df.limit(0).write.format("tempora").mode("append").save(f"{tmp_path}/parts")
    got = lambda **o: spark.read.format("tempora").options(**o).load(f"{tmp_path}/parts")
    want = [(r.id, r.s, r.x) for r in df.collect()]
    assert sorted(map(tuple, got().collect()), key=lambda r: r[0]) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for keep, test in (("id < 40 and s = 'k1' and x > 3.5", lambda r: r[0] < 40 and r[1] == "k1" and r[2] is not None and r[2] > 3.5), ("id in (3, 4) and x is null", lambda r: r[0] == 3), ("s like '%2'", lambda r: r[1] == "k2")):
        assert sorted(map(tuple, got(filters="true").where(keep).collect())) == [r for r in want if test(r)]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = store.StoreSource({"path": f"{tmp_path}/parts", "filters": "true"}).reader(df.schema)
    left = [EqualTo(("id",), 1.5), StringContains(("s",), "k")]
    assert list(reader.pushFilters([EqualTo(("s",), "k1"), *left, In(("id",), (1, 2, 4))])) == left
    assert sorted(i for p in reader.partitions() for b in reader.read(p) for i in b.column("id").to_pylist()) == [1, 4]


def test_parts_of_a_failed_write_are_not_seen(spark, tmp_path):
    spark.dataSource.register(store.StoreSource)
    spark.range(5).write.format("tempora").mode("append").save(f"{tmp_path}/parts")
    with pytest.raises(Exception, match="no row"):
        spark.range(0, 9, 1, 3).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no row"))).otherwise(F.col("id")).cast("bigint").alias("id")).write.format("tempora").mode("append").save(f"{tmp_path}/parts")
    assert spark.read.format("tempora").load(f"{tmp_path}/parts").count() == 5


def test_history_of_a_relational_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1, 21).selectExpr("id", "1L version", "id * 10 valid_from", f"{OPEN} valid_to", "id tx_time", "false tombstone", "id log_index", "0L ordinal", "concat('n', id) name")
    rows.write.jdbc(url, "history", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    h = store.jdbc_history(spark, url, "history", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, (1, 21, 4))
    h = h.toDF(*[c.lower() for c in h.columns])
    assert h.rdd.getNumPartitions() == 4 and h.count() == 20
    from tempora.operators import temporal

    assert [(r.id, r["name"]) for r in temporal.point(h, 7, 75, 10, ["name"]).collect()] == [(7, "n7")]


def test_transactions_start_at_the_frontier(spark, tmp_path):
    """Who commits second over the same vertex fails; a transaction reads what was there when it began."""
    w = GraphWriter(spark, f"file://{tmp_path}/w", [PropertySpec("name", "string"), PropertySpec("value", "integer")], [])
    a, b = (GraphSession(spark).attach_writer(w) for _ in range(2))
    a.query("CREATE (n {name: 'x', value: 1}) VALID FROM 5")
    value = lambda s: [r[0] for r in s.query("MATCH (n {name: 'x'}) RETURN n.value").collect()]
    for s in (a, b):
        s.query("BEGIN")
    a.query("MATCH (n {name: 'x'}) SET n.value = 2 VALID FROM 6")
    b.query("MATCH (n {name: 'x'}) SET n.value = 3 VALID FROM 6")
    a.query("COMMIT")
    assert value(a) == [2] and value(b) == [1]
    with pytest.raises(TransactionError, match="CONFLICT"):
        b.query("COMMIT")
    assert value(b) == [2]
    b.query("MATCH (n {name: 'x'}) SET n.value = 4 VALID FROM 7")
    assert value(a) == [4]
