import random
import re
import zlib

import numpy as np
import pytest

from tempora.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.op3_langid(spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.02
    kept = langid.accepted(docs.unionByName(spark.createDataFrame([(10**6, "xq zvkw jjqx wqz kkvx " * 20, None, "s", 1), (10**6 + 1, "12 34", None, "s", 1)], docs.schema)))
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000000").isEmpty()


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    x = np.array([rng.choice([97, 98, 99, 32]) for _ in range(4000)], dtype=np.uint32)
    grams = np.stack([x[i : len(x) - 3 + i] for i in range(4)], axis=1)
    counts = {n: np.unique(g, axis=0, return_counts=True) for n, g in (("a", grams[:1500]), ("b", grams[1500:]))}
    s = langid.Scorer(langid.fit(counts))
    floor = np.exp(s.model.floor)
    for context in ([97, 98, 99], [99, 99, 99], [32, 97, 120], [121, 122, 120]):
        total = np.zeros(2)
        for c in [97, 98, 99, 32]:
            h = langid.gram_hashes(np.array([2, 2, 2, 2, *context, c], dtype=np.uint32), 4)
            row = s.grams[4].rows(h[4][-1:])
            lp = s.log_p[4][row][0] if row[0] < len(s.log_p[4]) - 1 else s.back_off(h, np.array([7]))[0]
            total += np.exp(lp)
        assert (total <= 1 + 1e-5).all() and (total >= 1 - floor - 1e-5).all()


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_rule_statistics_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n \n", "a b c a b c a", "x\nx\n x\nx", "é\x85ü\xa0#|"]
    texts += ["".join(rng.choice("ab #|é\n\t\x0b😀<") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in texts:
        assert quality.statistics(None if t is None else t.encode())[0] == plain_statistics(t), repr(t)


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op8_quality(spark, SF).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    passed = [r for r in got if not r.base_failed and r.doc_id in labels]
    good, bad = ([r.kept for r in passed if labels[r.doc_id] == k] for k in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(9, 1, (30, 3))])
    s = quality.grow(x).score(x)
    assert s[900:].min() > np.quantile(s[:900], 0.95)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op10_toxicity(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    hit = [p for t, p in held if t]
    assert sum(hit) / len(hit) > 0.7 and sum(t for t, p in held if p) / sum(p for _, p in held) > 0.9


def test_pairs_count_where_single_terms_do_not():
    rng = random.Random(3)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.35
        rows.append(np.array(sorted({rng.randrange(1000, 1400) for _ in range(6)} | ({1} if a else set()) | ({2} if b else set())), dtype=np.int32))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y))
    score = lambda *c: m.raw(np.array(c, dtype=np.int64), np.array([len(c)]))[0]
    assert score(1, 2) > 0 > max(score(1), score(2))
    assert m.factor[1] @ m.factor[2] > 0.5


@pytest.mark.parametrize("f", [langid.op3_langid, quality.op8_quality, toxicity.op10_toxicity])
def test_odd_and_empty_tables(spark, odd, nothing, f):
    assert f(spark, odd).count() == 12
    assert f(spark, nothing).count() == 0


def test_language_tables_are_split_and_scores_are_not(monkeypatch):
    """Many languages: each block of TOGETHER has tables of its own, and the scores are those of one big table."""
    rng, counts = random.Random(6), {}
    for k in range(11):
        x = np.array([rng.choice([97 + k, 98 + k, 99 + k, 32]) for _ in range(900)], dtype=np.uint32)
        counts[f"l{k:02d}"] = np.unique(np.stack([x[i : len(x) - 3 + i] for i in range(4)], axis=1), axis=0, return_counts=True)
    alphabet = len({c for g, _ in counts.values() for c in g[:, -1].tolist()})
    names = sorted(counts)
    split = [langid.fit({n: counts[n] for n in names[i : i + 4]}, alphabet) for i in range(0, 11, 4)]
    texts = ["", None, "abc cab", "ijk kji", "".join(rng.choice("abcdefghijklm ") for _ in range(500)), "ünï"]
    one, many = langid.Panel([langid.fit(counts, alphabet)]), langid.Panel(split)
    assert one.languages == many.languages == names
    np.testing.assert_allclose(one.cross_entropy(texts)[0], many.cross_entropy(texts)[0], rtol=1e-5)
    assert sum(t.size for m in split for t in m.log_p) < sum(t.size for t in one.scorers[0].model.log_p) / 2


def test_many_languages_and_ties(spark, tables):
    rows = [(i, f"{chr(97 + i % 13) * 3} {chr(98 + i % 13) * 4}" * 3, f"l{i % 13:02d}") for i in range(400)]
    rows += [(1000, rows[0][1], None), (1001, "zzz", "a"), (1002, "zzz", "b"), (1006, "zzz", "a"), (1007, "zzz", "b")]
    got = {r.doc_id: r.lang_pred for r in langid.op3_langid(spark, tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))).collect()}
    assert all(got[i] == f"l{i % 13:02d}" for i in range(400)) and got[1000] == "l00"
    learned = {"a": {1001, 1006}, "b": {1002, 1007}}
    if all(any(crc(i, 4) != 2 for i in x) for x in learned.values()):
        assert len({got[i] for i in (1001, 1002, 1006, 1007)}) == 1


def brute_entropy(counts, alphabet, text):
    """Interpolated Kneser-Ney by dictionaries: nats per character of one language."""
    from collections import Counter, defaultdict

    grams = {4: Counter({tuple(g): int(n) for g, n in zip(counts[0].tolist(), counts[1])})}
    for order in (3, 2, 1):
        before = defaultdict(set)
        for g in grams[4]:
            before[g[4 - order :]].add(g[4 - order - 1])
        grams[order] = Counter({g: len(x) for g, x in before.items()})
    total, kinds, disc = {}, {}, {}
    for order, c in grams.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[order] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[order], kinds[order] = Counter(), Counter()
        for g, n in c.items():
            total[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / (alphabet + 1)
        order, h = len(g), g[:-1]
        if not total[order][h]:
            return p(g[1:])
        return (max(grams[order][g] - disc[order], 0) + disc[order] * kinds[order][h] * p(g[1:])) / total[order][h]

    x, span, _ = langid.characters([text])
    lo, hi = span[0]
    return sum(-np.log(p(tuple(x[i - 3 : i + 1].tolist()))) for i in range(lo, hi)) / max(hi - lo, 1)


def test_cross_entropy_equals_brute_force():
    rng = random.Random(11)
    corpora = {n: [" ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(8)] for n, a in (("x", "abcde"), ("y", "abxyzé"))}
    counts = {}
    for name, texts in corpora.items():
        x, span, _ = langid.characters(texts)
        at = np.concatenate([np.arange(lo, hi) for lo, hi in span])
        counts[name] = np.unique(np.stack([x[at - i] for i in (3, 2, 1, 0)], axis=1), axis=0, return_counts=True)
    alphabet = len({c for g, _ in counts.values() for c in g[:, -1].tolist()})
    panel = langid.Panel([langid.fit(counts, alphabet)])
    texts = [corpora["x"][0], corpora["y"][3], "abc", "unseen qqq é", "x"]
    got, _ = panel.cross_entropy(texts)
    want = [[brute_entropy(counts[n], alphabet, t) for n in ("x", "y")] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-4)


def brute_score(f, row):
    """The anomaly score of one row, tree by tree and node by node."""
    x, total = (row - f.middle) / f.unit, 0.0
    for t in range(len(f.feature)):
        node, still, level = 0, 1.0, 0
        while True:
            low, high = f.low[t, node], f.high[t, node]
            beyond = float(np.maximum(low - x, 0).sum() + np.maximum(x - high, 0).sum())
            if beyond > 0:
                parted = still * beyond / (beyond + float((high - low).sum()))
                total += parted * (level + 1)
                still -= parted
            if f.feature[t, node] < 0:
                total += still * f.depth[t, node]
                break
            node = f.child[t, node] + int(x[f.feature[t, node]] >= f.cut[t, node])
            level += 1
    return 2.0 ** (-total / len(f.feature) / f.norm)


def test_forest_scores_equal_brute_force():
    rng = np.random.default_rng(4)
    f = quality.grow(rng.normal(0, [1, 5, 0.1, 0], (400, 4)))
    rows = rng.normal(0, [2, 9, 0.1, 1], (60, 4))
    np.testing.assert_allclose(f.score(rows), [brute_score(f, r) for r in rows], rtol=1e-9)


def test_the_forest_beats_a_limit_for_each_share():
    """Junk that is a little off in several shares at once: the forest finds it where no limit on a single share of equal loss does."""
    rng = np.random.default_rng(5)
    good, more = rng.normal(0, 1, (3000, 6)), rng.normal(0, 1, (3000, 6))
    bad = rng.normal(0, 1, (600, 6)) + 2.3
    f = quality.grow(good)
    cut = np.quantile(f.score(more), 1 - quality.MAX_LOSS)
    limit = np.quantile(np.abs(more).max(axis=1), 1 - quality.MAX_LOSS)
    forest, limits = (f.score(bad) > cut).mean(), (np.abs(bad).max(axis=1) > limit).mean()
    assert forest > limits + 0.2, (forest, limits)


def test_threshold_ties():
    f = quality.grow(np.random.default_rng(1).normal(0, 1, (300, 2)))
    assert quality.calibrate(f, np.full(50, 0.4), np.full(50, 0.4), 0.3) == 0.4  # equal scores: none is rejected
    assert quality.calibrate(f, np.empty(0), np.full(5, 0.4), 0.3) == np.inf
    t = quality.calibrate(f, np.full(50, 0.4), np.full(50, 0.6), 0.3)
    assert 0.4 <= t < 0.6


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, rng.normal(size=toxicity.BUCKETS), rng.normal(size=(toxicity.BUCKETS, toxicity.RANK)), 0.7, -0.2)
    rows = [np.unique(rng.integers(0, toxicity.BUCKETS, n)) for n in (0, 1, 2, 9, 40)]
    want = [m.bias + m.weight[r].sum() + sum(m.factor[a] @ m.factor[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    length = np.array([len(r) for r in rows])
    np.testing.assert_allclose(m.raw(np.concatenate(rows), length), want, atol=1e-8)
    np.testing.assert_allclose(m.score(np.concatenate(rows), length), 1 / (1 + np.exp(-(0.7 * np.array(want) - 0.2))), atol=1e-9)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_factors_lift_the_held_out_score(spark, tables):
    """Toxic where both or neither of an insult and a group mention stand: no single term tells; held-out rows through the query, and without factors."""
    rng, rows, labels = random.Random(12), [], []
    filler = [f"w{i}" for i in range(150)]
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(8)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a == b)))
    d = tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, d).collect()}
    held = [i for i in got if got[i].held_out]
    y = np.array([labels[i][2] for i in held])
    with_factors = auc(np.array([got[i].score for i in held]), y)
    m = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).value
    linear = toxicity.Machine(m.bias, m.weight, np.zeros_like(m.factor))
    x = [toxicity.terms(rows[i][1]) for i in held]
    without = auc(linear.raw(np.concatenate(x), np.array([len(r) for r in x])), y)
    assert with_factors > 0.95 and without < 0.65, (with_factors, without)


def test_every_labelled_text_is_counted(spark, tables):
    """Words that one labelled text each has, among thousands of its language: all of them are learned."""
    common = {"a": "these are the words of one", "b": "und dies sind die der anderen"}
    rows = [(2 * i + k, f"{t} {chr(97 + i % 26)}", n) for i in range(2500) for k, (n, t) in enumerate(common.items())]
    rare = [(10_000 + i, chr(0x4E00 + i) * 6, "ab"[i % 2]) for i in range(160)]
    rare = [r for r in rare if crc(r[0], 4) != 2]
    asked = [(20_000 + i, t, None) for i, t, _ in rare]
    d = tables(documents=spark.createDataFrame(rows + rare + asked, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.op3_langid(spark, d).collect()}
    assert len(rare) > 100 and all(got[20_000 + i] == n for i, _, n in rare)


def test_the_forest_is_fitted_on_all_rows(spark, tables):
    """Units of all good rows that pass, and the threshold that all labelled scores give."""
    rng = random.Random(8)
    texts = {}
    for i in range(7200):
        junk = 0.12 if i % 8 == 0 else 0.02
        texts[i] = " ".join(("#" * rng.randint(1, 3) if rng.random() < junk else "w" + "x" * rng.randint(0, 9) + str(rng.randint(0, 10**6))) for _ in range(60))
    d = tables(documents=spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), labels=spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in texts if i % 10], "doc_id bigint, quality int, toxic int"))
    f = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).value
    x = np.array([quality.statistics(t.encode())[1] for t in texts.values()])
    assert not quality.base_failed(np.array([quality.statistics(t.encode())[0] for t in texts.values()])).any()
    i = np.arange(len(x))
    good, bad = (i % 10 > 0) & (i % 8 > 0), (i % 10 > 0) & (i % 8 == 0)
    assert good.sum() > 5000
    np.testing.assert_allclose(f.unit[x[good].std(axis=0) > 0], x[good].std(axis=0)[x[good].std(axis=0) > 0], rtol=1e-6)
    step = np.ceil(f.score(x) * quality.STEPS) / quality.STEPS
    assert f.threshold == quality.calibrate(f, step[good], step[bad], np.sort(step)[len(step) // 2 - 1])
    assert 0 < (step[bad] > f.threshold).mean() and (step[good] > f.threshold).mean() <= quality.MAX_LOSS
