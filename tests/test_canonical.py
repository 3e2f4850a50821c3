"""Canonical names of blank nodes against all renamings of small graphs, and worked graphs that colors alone cannot tell apart."""

import random
from collections import defaultdict
from itertools import permutations

from quarry.operators.canonical import adaptive_hash, canonical_hash, canonical_labels, complexity

SCHEMA = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def rows(g, triples):
    """Terms that begin with ? are blank nodes, with " literals."""
    kind = lambda t: "bnode" if t[0] == "?" else "literal" if t[0] == '"' else "iri"
    bare = lambda t: t[1:] if t[0] in '?"' else t
    return [(g, bare(s), kind(s), p, bare(o), kind(o), None, None) for s, p, o in triples]


def renamed(triples, rng):
    names = sorted({t for s, _, o in triples for t in (s, o) if t[0] == "?"})
    new = dict(zip(names, rng.sample([f"?n{i}" for i in range(100)], len(names))))
    out = [(new.get(s, s), p, new.get(o, o)) for s, p, o in triples]
    rng.shuffle(out)
    return out


def brute(triples):
    names = sorted({t for s, _, o in triples for t in (s, o) if t[0] == "?"})
    best = None
    for order in permutations(range(len(names))):
        new = {n: f"?{order[i]}" for i, n in enumerate(names)}
        lines = sorted({(new.get(s, s), p, new.get(o, o)) for s, p, o in triples})
        best = lines if best is None or lines < best else best
    return repr(best)


def classes(keys):
    by = defaultdict(list)
    for g, k in keys:
        by[k].append(g)
    return sorted(sorted(v) for v in by.values())


def both(*pairs):
    return [(f"?{a}", "urn:p", f"?{b}") for a, b in pairs] + [(f"?{b}", "urn:p", f"?{a}") for a, b in pairs]


HEXAGON = both((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0))
TRIANGLES = both((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3))
PRISM = TRIANGLES + both((0, 3), (1, 4), (2, 5))
BIPARTITE = both(*[(a, b) for a in (0, 1, 2) for b in (3, 4, 5)])
CLIQUE = both(*[(a, b) for a in range(9) for b in range(a)])
STAR = [("?0", "urn:p", f"?{i}") for i in range(1, 30)]
RING = [(f"?{i}", "urn:p", f"?{(i + 1) % 16}") for i in range(16)]


def test_small_graphs_against_all_renamings(spark):
    rng = random.Random(11)
    graphs = []
    for _ in range(30):
        n = rng.randint(1, 5)
        term = lambda: rng.choice([f"?{rng.randrange(n)}"] * 4 + ["urn:x", '"v'])
        triples = {(s if (s := term())[0] != '"' else "?0", rng.choice(["urn:p", "urn:p", "urn:q"]), term()) for _ in range(rng.randint(1, 7))}
        graphs += [sorted(triples), renamed(sorted(triples), rng)]
    data = [r for i, t in enumerate(graphs) for r in rows(f"g{i}", t)]
    got = canonical_hash(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r["hash"] for r in got)
    assert classes((r["g"], r["hash"]) for r in got) == classes((f"g{i}", brute(t)) for i, t in enumerate(graphs))


def test_graphs_that_colors_leave_tied(spark):
    rng = random.Random(5)
    shapes = [HEXAGON, TRIANGLES, PRISM, BIPARTITE, CLIQUE, STAR, RING, RING[:-1] + [("?15", "urn:p", "?15")], STAR + [("?1", "urn:q", '"one')], STAR + [("?1", "urn:q", '"one'), ("?2", "urn:q", '"one')]]
    graphs = [(f"{k}-{c}", renamed(t, rng)) for k, t in enumerate(shapes) for c in range(3)]
    got = canonical_hash(spark.createDataFrame([r for g, t in graphs for r in rows(g, t)], SCHEMA)).collect()
    assert all(r["hash"] for r in got)
    assert classes((r["g"], r["hash"]) for r in got) == sorted(sorted(f"{k}-{c}" for c in range(3)) for k in range(len(shapes)))
    # the hash is that of the graph, whatever else is in the table
    alone = canonical_hash(spark.createDataFrame(rows("x", renamed(PRISM, rng)), SCHEMA)).first()["hash"]
    assert alone == next(r["hash"] for r in got if r["g"] == "2-0")


def test_labels_repeats_and_empty(spark):
    data = rows("a", [("?x", "urn:p", "?y"), ("?y", "urn:p", "?x"), ("?x", "urn:p", "?y")]) * 2 + rows("b", [("urn:s", "urn:p", '"o')]) + rows(None, [("?x", "urn:p", '"o')])
    frame = spark.createDataFrame(data, SCHEMA)
    assert {r["g"] for r in canonical_hash(frame).collect()} == {"a", "b"}
    assert sorted(r["n"] for r in canonical_labels(frame).collect()) == ["<a>\nx", "<a>\ny", "DEFAULT\nx"]
    assert canonical_hash(spark.createDataFrame([], SCHEMA)).collect() == []


def test_too_many_ways_are_given_up(spark, monkeypatch):
    from quarry.operators import canonical

    monkeypatch.setattr(canonical, "MOST_BRANCHES", 3)
    two = both((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))  # a cube
    got = {r["g"]: r["hash"] for r in canonical_hash(spark.createDataFrame(rows("cube", two) + rows("ok", STAR), SCHEMA)).collect()}
    assert got["cube"] is None and len(got["ok"]) == 64


def test_adaptive(spark):
    frame = spark.createDataFrame(rows("simple", [("?a", "urn:p", '"x')]) + rows("hard", HEXAGON) + rows("other", TRIANGLES) + rows("star", STAR), SCHEMA)
    kinds = {r["g"]: r["complexity"] for r in complexity(frame).collect()}
    assert kinds == {"simple": "Simple", "hard": "Complex", "other": "Complex", "star": "Pathological"}
    got = {r["g"]: r for r in adaptive_hash(frame).collect()}
    assert {g: r["method"] for g, r in got.items()} == {"simple": "custom", "hard": "canonical", "other": "canonical", "star": "canonical"}
    assert got["hard"]["hash"] != got["other"]["hash"]


def test_graphs_that_are_plainly_the_same_are_named_once(spark, monkeypatch):
    from quarry.operators import canonical

    named = []
    monkeypatch.setattr(canonical, "canonical_quads", lambda quads, f=canonical.canonical_quads: (named.append(quads.select("g").distinct().count()), f(quads))[1])
    shape = lambda k: [(f"?{k}a", "urn:p", f"?{k}b"), (f"?{k}b", "urn:p", f"?{k}c"), (f"?{k}a", "urn:q", f'"{k % 3}')]
    frame = spark.createDataFrame([r for k in range(60) for r in rows(f"g{k}", shape(k))], SCHEMA)
    got = canonical_hash(frame).collect()
    assert classes((r["g"], r["hash"]) for r in got) == sorted(sorted(f"g{k}" for k in range(60) if k % 3 == m) for m in range(3))
    assert len(adaptive_hash(frame).collect()) == 60 and named[0] < 10 and sum(named) < 20
    # a term without a kind is no blank node
    odd = [(g, "x", "bnode", "urn:p", o, None, None, None) for g, o in (("a", "1"), ("b", "2"), ("c", "1"))]
    assert classes((r["g"], r["hash"]) for r in canonical_hash(spark.createDataFrame(odd, SCHEMA)).collect()) == [["a", "c"], ["b"]]
