import random

import pytest
from brute_simhash import groups

from tempora.llm import simhash


def near_copies(rng, n):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i + 100, " ".join(w)))
    return rows


def check(spark, tables, rows):
    d = tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, d).collect()), key=str)
    assert got == groups(rows)


def test_groups_equal_brute_force(spark, tables):
    rng = random.Random(3)
    rows = near_copies(rng, 60) + [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a  B"), (503, "a  B"), (None, "a b")]
    check(spark, tables, rows)


def test_hot_cells_are_cut_and_lose_nothing(spark, tables, monkeypatch):
    """Crowded cells of segments, and crowded cells of bits that are cut in chunks; none of either."""
    rows = near_copies(random.Random(4), 80)
    for limit in (8, 40):
        monkeypatch.setattr(simhash, "CELL_ROWS", limit)
        check(spark, tables, rows)


def test_rows_of_mass_copies_are_joined_by_broadcast(spark, tables, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    rows = near_copies(random.Random(6), 12)
    check(spark, tables, rows + [(900 + i, rows[0][1]) for i in range(20)] + [(None, None)] * 9)


def test_random_fingerprints_meet_few_others():
    """Of 10**6 random fingerprints each is compared with a few in all its cells; chance neighbours grow a cell only up to CELL_ROWS."""
    import numpy as np

    fp = np.random.default_rng(8).integers(0, 1 << 63, 10**6, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(9).integers(0, 2, 10**6, dtype=np.uint64)
    emb, met = simhash._embed(fp), 0
    for m in simhash.band_masks():
        _, n = np.unique(emb & np.uint64(m & (1 << 64) - 1), return_counts=True)
        assert n.max() <= simhash.CELL_ROWS
        met += int((n * (n - 1) // 2).sum())
    assert met < 8 * len(fp)
    fine = [np.unique(fp & np.uint64(m & (1 << 64) - 1), return_counts=True)[1] for m in simhash.band_masks(simhash.BAND_BITS, 1)]
    assert len(fine) == 56 and sum(int((n * (n - 1) // 2).sum()) for n in fine) < len(fp) / 10


def test_odd_and_empty_tables(spark, odd, nothing):
    assert simhash.op1_simhash(spark, odd).count() == 12
    zero = {r.doc_id for r in simhash.op1_simhash(spark, odd).where("fingerprint = '0000000000000000'").collect()}
    assert {2, 3} <= zero
    assert simhash.op1_simhash(spark, nothing).count() == 0


def test_one_of_each(spark):
    rows = [(2, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (3, "entirely other words in here"), (None, "entirely other words in here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, None], key=str)


def test_masks_cover_every_choice():
    assert len(simhash.band_masks()) == 20 and sum(simhash.BAND_SEGMENTS) == 32


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_lower_bound_never_exceeds_the_distance(bits):
    import numpy as np

    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(bits):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    assert (np.bitwise_count(simhash._embed(a) ^ simhash._embed(b)) <= np.bitwise_count(a ^ b)).all()
