"""Contexts in which many identifiers are of a form that the base patterns lack."""

import pytest

from tempora.llm import pii


def spans(spark, tables, texts):
    d = tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    return [r.spans for r in pii.op6_pii(spark, d).orderBy("doc_id").collect()]


@pytest.mark.parametrize("known, unknown", [(8, 2), (10, 10)])
def test_unseen_identifiers_do_not_count_against_a_context(spark, tables, known, unknown):
    texts = [f"phone: +1 (555) 010-{1000 + i} thanks" for i in range(known)] + [f"phone: 555-020-{1000 + i} thanks" for i in range(unknown)]
    assert spans(spark, tables, texts)[known:] == ["phone:7:19"] * unknown


def test_rounds_go_on_while_anything_is_found(spark, tables):
    texts = [f"wz +1 (555) 010-{1000 + i}" for i in range(10)]
    for k in range(5):  # each context is borne out by the one before
        for w in ("zabcd"[k], "abcde"[k]):
            texts += [f"w{w} 555-02{k}-{1000 + i}" for i in range(10)]
    assert all(x.startswith("phone:3:") for x in spans(spark, tables, texts))


def test_a_context_of_other_things_is_not_trusted(spark, tables):
    texts = [f"call +1 (555) 010-{1000 + i} now" for i in range(10)] + [f"call {i}xxxxxx now" for i in range(10)] + ["call 555-020-1000 now"]
    assert spans(spark, tables, texts)[-1] == ""


def test_identifiers_beside_other_numbers(spark, tables):
    texts = [f"call +1 (555) 010-{1000 + i} today" for i in range(20)]
    texts += ["call 555-010-9999 today", "in 2024 room 12345678901234567890 call 555-010-9998 today", "1234567890123456 " * 12 + "call 555-010-9997 today", "x" * 300 + "1 call 555-010-9996 today", "call:555-010-9995 today"]
    texts += ["call 2024 555-010-9994 today", "555-010-9993 today 11111 call"]
    got = spans(spark, tables, texts)[20:]
    for t, s in zip(texts[20:], got):
        found = {t[int(a) : int(b)] for _, a, b in (x.split(":") for x in s.split(",") if x)}
        assert any("555-010-999" in f for f in found), (t[-60:], s)


def test_marks_in_a_text_are_no_spans(spark, tables):
    texts = ["\ufdd0\ufdd1 a@b.cd \ufdd4 1.2.3.4 \ufdd3"] * 9
    assert set(spans(spark, tables, texts)) == {"email:3:9,ip:12:19"}


def test_masks_and_redaction_by_plain_code(spark):
    """Replacing against a loop over the spans, with spans that meet, touch and nest, near and far beyond a part of the text."""
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(7), []
    for k in range(60):
        n = rng.choice([5, 90, 1500, 4000])
        text = "".join(rng.choice("abé😀 ") for _ in range(n))
        sp = sorted({(rng.choice(pii.KINDS), a, min(n, a + rng.randint(1, 700))) for a in (rng.randrange(n) for _ in range(rng.choice([0, 1, 5, 200])))}, key=lambda x: (x[1], -x[2], x[0]))
        rows.append((k, text, sp))
    df = spark.createDataFrame(rows, f"k int, t string, sp {pii.SPAN}")
    sign = lambda x, m: f"case when {x}.s >= {m} then concat('<', upper({x}.kind), '>') else '' end"
    got = df.select("k", F.expr(pii.by_start("sp")).alias("sp"), "t").select("k", F.expr(pii.replaced("t", "sp", sign)).alias("r"), F.expr(pii.masked("t", "sp")).alias("m"), F.expr(pii.apart("sp")).alias("a")).collect()
    for r in got:
        _, text, sp = rows[r.k]
        out, mask, apart, at = "", list(text), [], 0
        for kind, s, e in sp:
            if s >= at:
                out += text[at:s] + f"<{kind.upper()}>"
                apart.append((kind, s, e))
            for i in range(max(s, at), e):
                mask[i] = pii.MASKS[kind]
            at = max(at, e)
        assert r.r == out + text[at:] and r.m == "".join(mask) and [tuple(x) for x in r.a] == apart


def test_work_is_near_linear_in_the_spans(spark):
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail.org or +1 (555) 010-{i % 9000 + 1000}" for i in range(n // 2))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        out = pii.redact(docs).first().text
        assert out.count("<EMAIL>") == out.count("<PHONE>") == n // 2
        return time.time() - began

    seconds(500)
    small, large = seconds(4000), seconds(64_000)
    assert large < 16 * max(small, 1.0)


def test_the_parser_keeps_little_of_the_expressions(spark):
    """States that Spark's parser holds for good, in the driver, after it has read the expressions."""
    held = spark._jvm.org.apache.spark.sql.catalyst.parser.AbstractParser.getDFACacheNumStates
    parser = spark._jsparkSession.sessionState().sqlParser()
    spark.conf.set("spark.sql.parser.manageParserCaches", "true")
    try:
        before = held()
        for x in (pii.base_spans("_s"), pii.candidates("_s", "base"), pii.replaced("_s", "base", lambda x, m: "'-'")):
            parser.parseExpression(x)
        assert held() - before < 2000
    finally:
        spark.conf.unset("spark.sql.parser.manageParserCaches")
