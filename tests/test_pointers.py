"""Pointer doubling against walks: long chains, shared ends, cycles, broken links."""

import random

from quarry.operators.pointers import depths, members

SCHEMA = "node string, next string"


def links():
    rng = random.Random(2)
    out = {f"a{i}": f"a{i + 1}" for i in range(700)} | {"a700": None}
    out |= {f"b{i}": f"b{i + 1}" for i in range(5)} | {"b5": "a690"}  # shares an end
    out |= {"c0": "c1", "c1": "c2", "c2": "c1", "c3": "c0", "self": "self"}  # a cycle and a way into it
    out |= {"d0": "gone", "e": None}
    rows = list(out.items())
    rng.shuffle(rows)
    return out, rows


def walk(out, node):
    path = [node]
    while (n := out.get(path[-1])) in out:
        if n in path:
            return None
        path.append(n)
    return path


def test_depths_and_members(spark):
    out, rows = links()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["node"]: (r["root"], r["depth"], r["cyclic"]) for r in depths(frame).collect()}
    assert got == {n: (None, None, True) if (p := walk(out, n)) is None else (p[-1], len(p) - 1, False) for n in out}
    heads = ["a0", "a700", "b0", "c3", "self", "d0", "e", "nowhere"]
    found = sorted(tuple(r) for r in members(frame, spark.createDataFrame([(h,) for h in [*heads, "a0", None]], "head string")).collect())
    assert found == sorted((h, n, i) for h in heads if h in out and walk(out, h) for i, n in enumerate(walk(out, h)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert depths(none).collect() == [] and members(none, none.selectExpr("node as head")).collect() == []
