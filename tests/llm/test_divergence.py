"""op11: the divergence of sources against brute force, with heavy and light terms, blocks, nulls and repeated rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, value int"


def made(sources, docs, seed=3):
    rng = random.Random(seed)
    words = ["the", "Of", "über", "日本", "x1y", "a,b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for i in range(docs):
        s = rng.choice(sources)
        own = words[: 6 + (hash(str(s)) * 0 + (len(str(s)) * 7 + sum(map(ord, str(s)))) % 80)]
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.randint(0, 25))), rng.choice(["en", "en", None, "de"]), s, "n", "t", 1))
    return rows + [(1, None, "en", "silent", None, None, None), (1, "the the", "en", None, None, None, None), (None, "", "zz", "", None, None, None), (5, "the the", "en", None, None, None, None), (7, "rare", "yy", "only", None, None, None)]


def brute(rows, least, top):
    counts, documents, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    for lang in documents:
        kept = sorted((t for t, n in documents[lang].items() if n >= least), key=str.encode)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (total(c) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if c[t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tile,block,held", [(2048, 128, 400_000), (7, 3, 10)])
def test_divergence(spark, monkeypatch, tile, block, held):
    monkeypatch.setattr(D, "TILE_TERMS", tile)
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "HELD_TERMS", held)
    rows = made(["a", "b", "cc", "d'", "é", "Z", "z9", "long name", None], 400)
    got = D.divergence(spark.createDataFrame(rows, SCHEMA), least=8, top=5)
    assert [c for c, _ in got.dtypes] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, 5)


def test_no_documents(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_counts(spark):
    big = 8 * 10**12
    got = spark.range(1).select(D.share(D.F.lit(big), D.F.lit(big * 3), D.F.lit(11)).alias("p"), D.share(D.F.lit(0), D.F.lit(0), D.F.lit(0)).alias("none")).first()
    assert got["p"] == 1 + 10**9 * (big + 5) // (big * 3 + 55) and got["none"] == 0
