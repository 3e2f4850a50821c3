"""The sequence model of op8 against brute force: contexts cross word ends, so the order of words counts."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import ppm
from tests.llm.test_operators import texts, words


@pytest.mark.parametrize("order", [2, 5])
def test_across(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 9_000)
    monkeypatch.setattr(ppm, "GROUP_BYTES", 9_000)
    made = [*texts(), "one two three four", "four three two one", "new \x00 one"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") % 3 != 0, order=order, across=True).collect()}
    seq = [[256, *" ".join(words(t or "")).encode(), 256] for t in made]
    edges = defaultdict(Counter)
    for j, s in enumerate(seq):
        for i in range(1, len(s) if j % 3 else 0):
            for k in range(min(order, i) + 1):
                edges[tuple(s[i - k : i])][s[i]] += 1

    def lp(s):
        out = 0.0
        for i in range(1, len(s)):
            seen = set()
            for k in range(min(order, i), -1, -1):
                here = edges.get(tuple(s[i - k : i]), {})
                left = {x: m for x, m in here.items() if x not in seen}
                total, d = sum(left.values()), len(left)
                if s[i] in left:
                    out += math.log10(left[s[i]] / (total + d))
                    break
                if d:
                    out += math.log10(d / (total + d))
                seen |= set(here)
            else:
                out -= math.log10(257 - len(seen))
        return out

    for j, s in enumerate(seq):
        assert got[j].score == pytest.approx(lp(s)), j
        assert got[j].n_tokens == len(words(made[j] or "")) + 1
    a, b = len(made) - 3, len(made) - 2
    assert got[a].score != pytest.approx(got[b].score)
    none = ppm.score(docs, F.lit(False), order=order, across=True).collect()
    assert all(r.score == pytest.approx(-math.log10(257) * (len(seq[r.doc_id]) - 1)) for r in none)


def test_query_counts_order(spark, tmp_path):
    """op8_ppm_score itself: the same words in another order score otherwise."""
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(20)] + [(20, "the cat sat on the mat"), (21, "mat the on sat cat the")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in ppm.op8_ppm_score(spark, str(tmp_path)).collect()}
    assert got[20] > got[21] + 0.1
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True), across=True).count() == 0
