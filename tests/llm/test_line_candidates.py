"""Lines that share frequent words but are not alike must not become candidates of each other."""

import random

from quarry.llm import linededup


def test_long_lines_with_common_words_are_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(1200)]
    lines = [rng.sample(vocabulary, 180) for _ in range(120)]
    lines += [[*lines[k][:170], *(f"x{k}y{i}" for i in range(10))] for k in range(10)]  # alike: 170 of 190
    frame = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(lines)], "doc_id long, text string")
    pairs, written = [], linededup.written

    def counted(df):
        out = written(df)
        if out.columns == ["d", "l", "ad", "al"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", counted)
    got = {(r.d, r.l) for r in linededup.later_matches(frame).collect()}
    sets = [set(words) for words in lines]
    want = {(b, 0) for b in range(len(sets)) if any(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a in range(b))}
    assert got == want and len(want) == 10
    assert sum(pairs) <= 200  # of 8,385
