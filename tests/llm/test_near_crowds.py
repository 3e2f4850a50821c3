"""Texts that share a common passage but are not near must not become candidates of each other."""

import random

import numpy as np

from quarry.llm import simhash


def test_part_keys_meet_all_that_are_alike():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        n = int(rng.integers(1, 12)) if rng.random() < 0.3 else int(rng.integers(1, 700))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        gone, new = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 64, new, dtype=np.uint64)])
        a = np.unique(a)
        if 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.part_keys(a), simhash.part_keys(b)))


def test_crowds_are_no_candidates(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(12)]
    made = [[*passage, *(f"w{rng.randrange(10**6)}" for _ in range(60))] for _ in range(150)]
    made += [[*w[:66], "x", *w[67:]] for w in made[:5]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    pairs, written = [], simhash.written

    def counted(df):
        out = written(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "_rarity", lambda docs, shingle: np.zeros(simhash.COUNTERS, np.uint8))  # as over a large table, where counters are shared
    got = {r.doc_id: r.component_id for r in simhash.near_sets(docs).collect()}
    assert got == {i: i if i < 150 else i - 150 for i in range(155)}
    assert max(pairs) <= 1000  # of 11,935
