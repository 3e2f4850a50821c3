"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

import corpus_pipeline
from quarry.llm import simhash


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_near_stage(spark):
    """Copies with words changed, most of them more than 3 bits apart, in chains that only link over one another."""
    rng = random.Random(3)
    made = []
    for _ in range(12):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(6):
            made.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(4000)}"
    made += [None, "", " ", "one", "One", "a b c d", "a b c d e", "a b c d e f"] + ["some line that is common " + " ".join(f"u{rng.randrange(4000)}" for _ in range(40)) for _ in range(20)]
    rng.shuffle(made)
    sets = [shingles(t) for t in made]
    bits = [simhash.simhash((t or "").lower(), 5) for t in made]
    low, far = list(range(len(made))), 0
    for _ in made:
        for i in range(len(made)):
            for j in range(i):
                if near(sets[i], sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    for i in range(len(made)):
        far += any(near(sets[i], sets[j]) and (bits[i] ^ bits[j]).bit_count() > 3 for j in range(i))
    assert far > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == [i for i in range(len(made)) if low[i] == i]
