"""Rows that repeat an id are documents of their own: brute force over tables with repeated ids, equal and different texts."""

import random
import re

import pytest

from quarry.llm import linededup, repeats, simhash

SCHEMA = "doc_id long, text string, _key string, kept int, d long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def in_order(rows):
    return sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))


def without_repeats(rows, length):
    seen, out = set(), []
    for i, t in in_order(rows):
        data = (t or "").encode()
        gone = set()
        for a in range(len(data) - length + 1):
            s = data[a : a + length]
            if s in seen:
                gone.update(range(a, a + length))
            seen.add(s)
        out.append((i, bytes(b for k, b in enumerate(data) if k not in gone)))
    return sorted(out)


def test_strings(spark):
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = part(300)
    rows = [(2, "x" * 3 + shared[:249]), (2, part(120) + shared), (2, part(120)), (3, shared), (3, shared), (1, part(50)), (1, None), (4, shared[100:] + part(9)), (None, shared), (None, shared)]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got if r["doc_id"] is not None) == without_repeats(rows, 100)
    assert [bytes(r["kept"]).decode() for r in got if r["doc_id"] is None] == [shared, shared]


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def test_lines(spark):
    rows = [(5, "one two three\nfour five"), (5, "four five\nsix"), (5, "six\nseven eight"), (5, "six\nseven eight"), (2, "one two three"), (2, "one two three\nnine"), (7, None), (7, ""), (None, "six"), (None, "six")]
    seen, want = [], []
    for i, t in in_order(rows):
        kept = []
        for line in (t or "").split("\n"):
            w = words(line)
            if not (w and any(10 * len(w & x) >= 8 * len(w | x) for x in seen)):
                kept.append(line)
            seen += [w] if w else []
        want.append((i, None if t is None else "\n".join(kept)))
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None), key=repr) == sorted(want, key=repr)
    assert [r["text"] for r in got if r["doc_id"] is None] == ["six", "six"]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(200))
    rows = [(3, text), (3, "some other text of its own that nothing else is like at all"), (3, text + " end"), (9, text), (9, "a third text that stands alone here with words"), (1, text + " more"), (None, text), (None, None)]
    got = simhash.keep_first(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, text + " more"), (3, rows[1][1]), (9, rows[4][1]), (None, text), (None, None)], key=repr)
