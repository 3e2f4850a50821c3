"""Turtle read in a graph's row: the plain reader against the whole one, hashes against quads, and the round trip's plan."""

import random

from pyspark.sql import functions as F

from quarry.operators.ledger import graph_hash, quads_hash
from quarry.sources.quads import COLUMNS, _any_triples, _plain_triples, parse_turtle, turtle_hashes
from tests.test_narrow import odd, plan_of, same_as_sql  # noqa: F401

DOCUMENT = '@prefix c: <urn:c#> .\n@prefix : <urn:d#> .\n\n<urn:a> c:p "x y" , _:b1 ;\n    :q c:o.r/s .\n_:b1 c:p <urn:a> .\n'
PIECES = ["<urn:a>", "<a>", "<urn:x#y>", "c:p", ":q", "c:", "-a:b", "5:x", "d:e", "_:b1", "_:", '"x # y"', '""', '"', '"""', "'t'", '"e\\n"', "5", "-.5", "a", "true", "@en", "^^", ".", ";", ",", "[", "]", "(", ")", "# c\n", "@prefix", "@prefixed", "@base", "PREFIX", "@prefix c: <urn:e#> .", "<", "é:ü", "\n"]


def outcome(text):
    try:
        return _any_triples(text)
    except (ValueError, KeyError):
        return "no Turtle"


def test_plain_is_what_the_whole_reader_reads():
    assert _plain_triples(DOCUMENT) == _any_triples(DOCUMENT) and len(_plain_triples(DOCUMENT)) == 4
    rng, plain = random.Random(5), 0
    for _ in range(20_000):
        tokens = DOCUMENT.split(" ")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(tokens))
            tokens[at : at + rng.randint(0, 2)] = rng.choices(PIECES, k=rng.randint(0, 3))
        text = "".join(t + rng.choice([" ", " ", " ", ""]) for t in tokens)
        found = _plain_triples(text)
        plain += found is not None
        assert found is None or found == outcome(text), text
    assert plain > 2000


def test_hashes_are_those_of_the_quads(spark):
    texts = [DOCUMENT, DOCUMENT + '<urn:a> c:p "x y" , 5 , "z"@en , "v"^^<urn:t> , "\\n\\"\\\\" , "s"^^<http://www.w3.org/2001/XMLSchema#string> .', 'no "Turtle"\n', "", None, "<urn:a> <urn:b> [] ."]
    files = spark.createDataFrame([(f"g{i}", t, i) for i, t in enumerate(texts * 40)], "g string, text string, n int")
    found = turtle_hashes(files)
    assert found.columns == ["g", "n", "triples", "hash"] and found.count() == 240
    quads = parse_turtle(files)
    wanted = sorted(map(tuple, graph_hash(quads, F.count(F.lit(1)).alias("triples")).select("g", "triples", "hash").collect()))
    assert sorted(map(tuple, found.where("triples > 0").select("g", "triples", "hash").collect())) == wanted
    rows = quads.groupBy("g").agg(F.collect_list(F.struct(*COLUMNS[1:])).alias("quads")).select("g", quads_hash("quads").alias("hash"))
    assert sorted(map(tuple, rows.collect())) == [(g, h) for g, _, h in wanted]
    assert turtle_hashes(files.limit(0)).collect() == []


def test_round_trip_stays_in_its_row(spark, odd):  # noqa: F811
    lines = plan_of(spark, "turtle_round_trip")
    assert sum("Exchange" in line for line in lines) == 1 and not any("Join" in line for line in lines)
    same_as_sql(spark, "turtle_round_trip", odd)
