"""Kinds of junk that the sample and its labels do not have."""

import numpy as np

from tempora.llm import quality

SF = "/root/testdata/sf0.01"
KINDS = {
    "capitals": lambda t: t.upper(),
    "digits": lambda t: "".join("0123456789"[ord(c) % 10] if c.isalpha() else c for c in t),
    "marks": lambda t: " ".join(w + "?!;" for w in t.split()),
    "giant words": lambda t: " ".join("".join(t.split()[i : i + 9]) for i in range(len(t.split()))),
    "symbols": lambda t: t + " " + "#" * (len(t) // 20),
}


def test_junk_that_the_sample_lacks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").limit(60).select("text").collect()
    texts = [(10**7 + 100 * i + k, f(r.text)) for i, r in enumerate(good) for k, f in enumerate(KINDS.values())]
    forest = quality.fit(docs, labels)
    got = {}
    for i, t in texts:
        counts, shares = quality.statistics(t.encode())
        if not quality.base_failed(np.array([counts]))[0]:
            got.setdefault(list(KINDS)[i % 100], []).append(shares)
    kept = {k: float((forest.value.score(np.array(v)) <= forest.value.threshold).mean()) for k, v in got.items()}
    assert kept.keys() == KINDS.keys() and max(kept.values()) < 0.1, kept


def test_a_feature_that_never_varies_counts_when_it_does():
    x = np.random.default_rng(0).normal(0, 1, (600, 3))
    x[:, 2] = 0
    s = quality.grow(x).score(np.array([[0, 0, 0], [0, 0, 20], [0, 20, 0]]))
    assert min(s[1:]) > s[0] + 0.2
