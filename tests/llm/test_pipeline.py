import hashlib

import pytest
from brute_simhash import groups

import corpus_pipeline
from tempora.llm import langid, pii, quality
from tempora.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    docs = table(spark, SF, "documents")
    rejected = {r.doc_id for r in langid.op3_langid(spark, SF).where("rejected").collect()}
    one = corpus_pipeline.language(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - rejected
    bad = {r.doc_id for r in quality.judge(one, table(spark, SF, "labels")).where("not kept").collect()}
    two = corpus_pipeline.rules(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect()} - bad
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = corpus_pipeline.near_duplicates(spark, two, SF)
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for _, _, c in groups(rows)})
    four = corpus_pipeline.personal_data(spark, three, SF)
    spans = {r.doc_id: r.spans for r in pii.find(three).collect()}
    old = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        want = old[r.doc_id]
        for s in sorted(spans[r.doc_id], key=lambda s: -s.s):
            want = want[: s.s] + f"<{s.kind.upper()}>" + want[s.e :]
        assert r.text == want and r.n_chars == len(want)
    five = corpus_pipeline.packed(spark, four, SF)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_run_is_the_stages_in_order(spark):
    a = corpus_pipeline.run(spark, SF)
    rows = sorted(map(str, a.collect()))
    assert rows and len(a.columns) == 7 and hashlib.sha256("".join(rows).encode()).hexdigest() == hashlib.sha256("".join(sorted(map(str, corpus_pipeline.run(spark, SF).collect()))).encode()).hexdigest()


def test_odd_and_empty_tables(spark, odd, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = table(spark, odd, "documents")
    one = corpus_pipeline.language(spark, docs, odd)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()}.isdisjoint({2, 3})  # null and empty texts have no language
    two = corpus_pipeline.rules(spark, one, odd)
    assert two.columns == docs.columns and all(len((r.text or "").split()) >= 50 for r in two.collect())
    three = corpus_pipeline.near_duplicates(spark, docs, odd)
    ids = [r.doc_id for r in three.collect()]
    assert three.columns == docs.columns and ids.count(1) == 1 and len([i for i in ids if i in (2, 3)]) == 1
    four = corpus_pipeline.personal_data(spark, docs, odd)
    got = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and four.count() == docs.count() and all(r.spans == r.fp == "clash" for r in got.values())
    assert "<EMAIL>" in "".join(r.text or "" for r in four.where("doc_id = 9").collect()) and "<PHONE>" in got[None].text and got[2].text is None
    five = corpus_pipeline.packed(spark, docs, odd)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in docs.collect()}
    kept = {r.doc_id for r in two.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()} <= kept


@pytest.mark.parametrize("name", ["pipeline", *(f"op{n}_" for n in range(1, 11))])
def test_registered(name):
    import __spark_entry__

    assert any(q.startswith(name) for q in __spark_entry__.queries())
