"""op12: the search against brute force over all documents, with ties, repeated ids, blocks of items and small tasks."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.llm import lexical as S

SCHEMA = "doc_id long, text string, item_id long, row long, score double"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    words = ["The", "of", "über", "日本", "42", "x-y"] + [f"w{i}" for i in range(150)]
    pick = lambda: words[min(len(words) - 1, int(rng.expovariate(0.05)))]
    docs = [(i, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(250)]
    items = [(i, " ".join(pick() for _ in range(rng.randint(1, 15)))) for i in range(25)]
    docs += [(900 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1])] * 2 + [(3, docs[9][1]), (None, docs[3][1]), (None, None), (901, ""), (902, "\x00 ...")]
    docs += [(1000 + i, items[0][1] + " " + "pad " * i) for i in range(15)] + [(2000, "w1 " * 5000)]
    return docs, items + [(0, items[1][1]), (77, None), (78, ""), (79, "nowhere"), (80, docs[3][1]), (None, "the w3")]


@pytest.mark.parametrize("cells,block,top", [(2_000_000, 4_000_000, 10), (40, 300, 10), (100, 4_000_000, 1), (2_000_000, 4_000_000, 400)])
def test_search(spark, monkeypatch, cells, block, top):
    monkeypatch.setattr(S, "CELLS", cells)
    docs, items = made(cells + top)
    frame = spark.createDataFrame([(*d, 1, 2, 0.5) for d in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = S.search(frame, asked, top=top, block_bytes=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, top)


def test_floors_cut_candidates():
    """A floor above what frequent terms can bring leaves no candidates from them, and loses nothing that reaches it."""
    import numpy as np

    plan = S.Plan([[0, 1, 2]], np.array([1, 10, 100]), np.array([9, 9, 9]), np.array([5, 5, 5]), 10)
    assert plan.floor.tolist() == [500] and plan.sum.tolist() == [9, 99, 999]
    doc, term = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 0])
    d, i, score = plan.candidates(doc, term, np.array([9, 90, 90, 500, 9]), 3, plan.floor)
    assert d.tolist() == [1] and score.tolist() == [590]
    assert plan.candidates(doc, term, np.array([9, 90, 90, 500, 9]), 3, np.zeros(1, dtype=int))[2].tolist() == [99, 590, 9]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.search(none, items).collect() == []
    assert S.search(spark.createDataFrame([(1, "a", 1, 1, 1.0)], SCHEMA), items.limit(0)).collect() == []
    assert S.search(none, items).columns == ["item_id", "rank", "doc_id", "score"]
