import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import bpe, chat, licenses, packing, pii

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path(request.param)
    return tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Table(path))


def strange(rng, n):
    wide = [chr(c) for c in [*range(32, 127), 10, 9, 13, 10, 32, 32, *range(0xA0, 0x250), 0x301, 0x3A3, 0x4E00, 0x1F600, 0x3000, 0x85]]
    out = ["", " ", "  ", "\n", "a\n\nb", "it's we'll !'s  's ''s q't'sa", "a   b", "<|endoftext|>x<|endoftext|> y", "x" * 3000, "İ ΣΑΣ é", "123 ٣٤ ²³", "日本 😀"]
    for k in range(n):
        out.append("".join(rng.choice(wide if k % 2 else "'sdtlmrve  \n!1a") for _ in range(rng.randint(0, 50))))
    return out


def test_ids_equal_the_library(pair):
    tok, own = pair
    texts = strange(random.Random(1), 800)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # cold and remembered
        assert [i.tolist() for i in own.encode(texts)] == want


def test_transducer_is_bounded_and_exact(pair):
    tok, own = pair
    rng = random.Random(2)
    for s in ("abcxyz" * 300, "the" * 900, "".join(rng.choice("etaoinshr") for _ in range(5000))):
        t, out = bpe.Transducer(own.table), []
        for i in range(0, len(s), 7):
            out += t.feed(s[i : i + 7].encode())
            assert len(t.held) <= own.table.window
        assert out + t.finish() == tok.encode(s, add_special_tokens=False).ids


def test_decoder_keeps_unfinished_characters():
    table = bpe.Table(bpe.tokenizer_path(FILES[0]))
    ids = bpe.Encoder(table).encode(["né 😀 日本"])[0]
    d = bpe.Decoder(table)
    assert "".join(d.feed(ids[i : i + 1]) for i in range(len(ids))) + d.finish() == "né 😀 日本"
    assert bpe.Decoder(table).feed(ids[:0]) == ""


def test_op5(spark, odd, nothing):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path(FILES[0]))
    want = set()
    for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in bpe.op5_bpe(spark, odd).collect()} == want
    assert bpe.op5_bpe(spark, nothing).count() == 0


# ---- packing

def test_first_fit_decreasing_equals_the_plain_way():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(1, 4096) for _ in range(rng.randint(0, 90))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(4096)
            room[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes) == want


def test_op7(spark, odd, nothing):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path(FILES[1]))
    rows = packing.op7_packing(spark, odd).toPandas()
    want = []
    for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            want.append((r.doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = [(None if d != d else int(d), *map(int, x)) for d, *x in rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.op7_packing(spark, nothing).count() == 0


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plain_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_brute_force(spark, tables):
    rng = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111.", "+1 (555) 123-4567 +12 + 3", "é😀 a@b.cd", "5" * 3000, "a" * 20_000, "1." * 5000, "+1" + " " * 3000]
    texts += ["".join(rng.choice("a1b2.@ -+()%_é059\n") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["4111111111111111", "378282246310005", "1.2.3.4", "+1 555 123 4567", "x@y.zz", "99", "a.b", "-", "é"]) for _ in range(rng.randint(0, 600))) for _ in range(8)]
    d = tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: r for r in pii.op6_pii(spark, d).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), repr(t)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_contexts_find_what_the_patterns_miss(spark, tables):
    rows = [(i, f"please call +1 (555) 010-{1000 + i} today about item {i} {i}") for i in range(40)]
    rows += [(100, "please call 555-010-9999 today"), (101, "order 555-010-9999x today"), (102, "please call 12 today")]
    d = tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.spans for r in pii.op6_pii(spark, d).collect()}
    assert got[100] == "phone:12:24" and got[101] == got[102] == "" and got[3] == "phone:12:29"


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é@x a@b.cd, 1.2.3.4!", "en", "s", 9), (2, None, None, None, None), (3, "clean", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "mail é@x <EMAIL>, <IP>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and pii.redact(docs).columns == docs.columns


def test_pii_odd_and_empty_tables(spark, odd, nothing):
    got = pii.op6_pii(spark, odd)
    assert got.count() == 12 and got.where("n_email = 400").count() == 1
    assert pii.op6_pii(spark, nothing).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert pii.redact(docs).count() == 12


# ---- licenses

@pytest.mark.parametrize("text, want", [
    ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"),
    ("licensed under the APACHE license version 2.0", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Released under the MIT License.", "MIT"),
    ("# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software", "MIT"),
    ("The driver has a license and the license is valid.", ""), ("", ""), (None, ""),
])
def test_license_texts(text, want):
    assert ",".join(sorted({m[2] for m in licenses.scan(text)[1]})) == want


def test_op4(spark, odd, nothing):
    assert licenses.op4_licenses(spark, odd).count() == 12 and licenses.op4_licenses(spark, nothing).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.licenses for r in licenses.op4_licenses(spark, "/root/testdata/sf0.01").collect()}
    for name, line in (("GPL-3.0-only", "GNU General Public License, version 3."), ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "CC BY-NC 4.0."), ("Apache-2.0", "Apache License, Version 2.0.")):
        assert {i for i, x in got.items() if name in x.split(",")} == {r.doc_id for r in docs.where(F.contains("text", F.lit(line))).collect()}


# ---- conversations

TALK = "conv_id bigint, turn bigint, role string, text string"


def test_quotes_become_threads(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rows = [
        (1, 0, "user", "How do I sort a list?\nAnd a dict?"), (1, 1, "assistant", "Use sorted().\n\nDicts keep order."), (1, 2, "user", "On Monday, A wrote:\n> Use   SORTED().\nBut stable?"),
        (1, 3, "user", "> And a dict?\nYes."), (1, 4, "assistant", "> > Use sorted().\n> But stable?\nIt is."), (1, 5, "user", "> never said\nhm"), (1, 6, "user", "> It is.\nThanks"),
        (2, 1, "user", "> Use sorted().\nother talk"), (None, 1, "user", "> Use sorted()."), (1, None, "user", "> It is."), (3, 0, None, None), (1, 1, "assistant", "Use sorted()."),
    ]
    got = {}
    for r in chat.link(spark.createDataFrame(rows, TALK)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.parent_turn, r.root_turn, r.depth, r.text))
    assert got[1, 2] == [(1, 1, 1, "But stable?")] and got[1, 3] == [(0, 0, 1, "Yes.")]
    assert got[1, 4] == [(2, 1, 2, "It is.")] and got[1, 6] == [(4, 1, 3, "Thanks")]
    assert got[1, 5] == [(None, 5, 0, "hm")] and got[2, 1] == [(None, 1, 0, "other talk")]
    assert len(got[1, 1]) == 2 and got[3, 0] == [(None, 0, 0, "")] and sum(map(len, got.values())) == len(rows)


def test_positions_follow_the_turns_of_a_thread(spark):
    rows = [(1, 5, "user", "first question here"), (1, 9, "assistant", "> first question here\nan answer"), (1, 12, "user", "> an answer\nthanks"), (1, 7, "assistant", "> first question here\nother answer"), (1, 12, "user", "> an answer\nthanks"), (1, 8, "user", "unrelated"), (2, 5, "user", "first question here")]
    got = sorted((r.conv_id, r.root_turn, r.position, r.turn) for r in chat.link(spark.createDataFrame(rows, TALK)).collect())
    assert got == [(1, 5, 0, 5), (1, 5, 1, 7), (1, 5, 2, 9), (1, 5, 3, 12), (1, 5, 3, 12), (1, 8, 0, 8), (2, 5, 0, 5)]


def plain_passages(text):
    """Runs of lines of one quote level, cut at blank lines: (level, body) by plain code."""
    out = []
    for line in re.split(r"\r?\n", text):
        m = re.match(r"\s{0,3}((?:>\s?)+)", line)
        level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == level and body.strip(" "):
            out[-1][1] += " " + body
        else:
            out.append([level, body])
    return [(a, re.sub(r"\s+", " ", b).strip(" ").lower()) for a, b in out if b.strip(" ")]


def test_passages_equal_plain_code(spark):
    rng = random.Random(13)
    texts = ["\n".join(rng.choice(["", "> ", ">> ", "> > ", "  "]) + rng.choice(["", " ", "Aa b", "c", ">"]) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", chat._passages(chat._lines(F.col("t"))).alias("p"))
    for r in df.collect():
        got = [(x.level, re.sub(r"\s+", " ", x.body).strip(" ").lower()) for x in r.p if x.body.strip(" ")]
        assert got == plain_passages(texts[r.k]), repr(texts[r.k])


def test_long_messages_and_other_columns(spark):
    text = "\n".join(f"> quoted line {i}" if i % 2 else f"own line {i}" for i in range(40_000))
    rows = [(1, 0, "user", "quoted line 1"), (1, 1, "user", text)]
    talk = spark.createDataFrame(rows, TALK)
    for c in ("quotes", "passages", "lines", "own", "h", "level", "position", "n", "block"):
        talk = talk.withColumn(c, F.lit("clash"))
    got = {r.turn: r for r in chat.link(talk).collect()}
    assert got[1].n_quotes == 20_000 and got[1].parent_turn == 0 and got[1].position == 1 and got[1].n_linked == 1


def test_long_chain_and_plain_tables(spark, nothing):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth) for r in chat.link(spark.createDataFrame(rows, TALK)).collect()}
    assert got[0] == (None, 0, 0) and all(got[i] == (i - 1, 0, i) for i in range(1, 70))
    assert chat.op9_chat(spark, nothing).count() == 0
    plain = chat.op9_chat(spark, "/root/testdata/sf0.001")
    assert plain.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_polynomial_hash_are_told_apart(pair):
    """Words that collide under every polynomial hash with an odd base modulo 2**64, in one batch and across batches."""
    tok, own = pair
    texts = [" ".join(thue_morse(n, w) for w in ("ab", "ba", "AB", "xy")) for n in (512, 1024, 2048, 4096)]
    texts += [thue_morse(1024, "ab"), thue_morse(1024, "ba"), thue_morse(1024, "ab")]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in own.encode(texts)] == want
    assert [own.encode([t])[0].tolist() for t in texts] == want


@pytest.mark.parametrize("spread", [1, 3, 50])
def test_pre_tokens_of_any_clashing_hash(pair, spread):
    """With a hash of few values every pre-token clashes; runs are still told apart."""
    x = np.frombuffer("".join(random.Random(spread).choice("abc") for _ in range(600)).encode("utf-32-le"), dtype=np.uint32)
    text = x.tobytes().decode("utf-32-le")
    start = np.unique(np.random.default_rng(spread).integers(0, 600, 220))
    end = np.append(start[1:], 600)
    where, kind = bpe.distinct(x, text, start, end, (start % spread).astype(np.uint64))
    words = [text[a:b] for a, b in zip(start, end)]
    assert [words[where[k]] for k in kind] == words and len({words[i] for i in where}) == len(set(words))


@pytest.mark.parametrize("op, name", [(bpe.op5_bpe, FILES[0]), (packing.op7_packing, FILES[1])])
def test_clashing_words_through_the_queries(spark, tables, op, name):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path(name))
    texts = [thue_morse(1024, "ab"), thue_morse(1024, "ba"), thue_morse(2048, "ba") + " " + thue_morse(2048, "ab")]
    d = tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    got = {r.doc_id: r for r in op(spark, d).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        if name == FILES[0]:
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        else:
            assert got[i].ids_crc32 == zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
