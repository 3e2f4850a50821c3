"""Field rules, ontology checks, enrichment and event documents on small tables with odd rows."""

import json

from pyspark.sql import functions as F

from quarry.functions import fields
from quarry.operators import ontology
from quarry.operators.enrich import Resolver, enrich
from quarry.sources.epcis import document, event_jsonld, event_turtle
from quarry.sources.quads import RDF

Q = "g string, s string, p string, o string"


def test_first_rule_that_is_broken_wins(spark):
    df = spark.createDataFrame([(None,), ("",), ("é",), ("abcdef",), ("a b\n",), ("abc\n",), ("abc",)], "c string")
    c = F.col("c")
    rows = df.select(fields.first_broken(required=fields.required(c), min=fields.shorter(c, 3), max=fields.longer(c, 5), username=fields.unlike(c, fields.USERNAME)).alias("x")).collect()
    assert [r.x for r in rows] == ["required", "required", "min", "max", "username", "username", None]
    rows = spark.createDataFrame([(None,), ("ok",), ("Re-Created",), ("o'x",), ("onLoad",)], "c string").select(fields.first_broken(bad=fields.injected(c)).alias("x")).collect()
    assert [r.x for r in rows] == [None, None, "bad", "bad", "bad"]


def test_ranges_of_days(spark):
    rows = [("1997-01-01", "1998-12-31", None), ("1997-01-01", "1999-01-02", "span"), ("1998-01-02", "1998-01-01", "order"), ("1999-01-01", "1999-01-02", "future"), ("1992-01-01", "1992-12-31", "past"), ("1992-01-01", "1993-01-01", None), (None, None, "start"), ("1997-01-01", "1997-1-2", "end"), ("1997-02-29", "1997-03-01", "start"), ("1997-01-01T00", "1997-03-01", "start")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    got = df.select("want", fields.range_problem(F.col("a"), F.col("b"), F.lit("1997-12-31").cast("date")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_shards_stay_in_range(spark):
    df = spark.createDataFrame([(None,), ("",), ("Zed",), ("apple",), ("zoo",), ("éclair",)], "k string")
    for n in (1, 3, 8, 26, 40):
        for f in (fields.hash_shard, fields.range_shard, fields.composite_shard):
            assert all(0 <= r.x < n for r in df.select(f(F.col("k"), n).alias("x")).collect())


def test_contradictions_and_empty_quads(spark):
    o = ontology.OWL
    rows = [("g", "a", o + "equivalentClass", "b"), ("g", "a", o + "disjointWith", "b"), ("g", "a", o + "disjointWith", "b"), ("g", "b", o + "disjointWith", "a"), ("g", "p", RDF + "type", o + "SymmetricProperty"), ("h", "p", RDF + "type", o + "AsymmetricProperty"), ("g", "q", RDF + "type", o + "ReflexiveProperty"), (None, None, None, None)]
    got = ontology.contradictions(spark.createDataFrame(rows, Q)).collect()
    assert sorted(map(tuple, got)) == [("SymmetricProperty", "p", None), ("equivalentClass", "a", "b")]
    empty = spark.createDataFrame([], Q)
    assert not ontology.contradictions(empty).collect() and not ontology.classes(empty, "").collect() and not ontology.shapes(empty).collect()


def test_shapes_keep_blank_nodes_of_graphs_apart(spark):
    sh = ontology.SHACL
    rows = [(g, "s" + g, p, o) for g in "ab" for p, o in ((RDF + "type", sh + "NodeShape"), (sh + "targetClass", "C"), (sh + "property", "_:x"))]
    rows += [("a", "_:x", sh + "path", "p1"), ("b", "_:x", sh + "path", "p2"), ("b", "_:x", sh + "minCount", "2")]
    got = ontology.shapes(spark.createDataFrame(rows, Q)).collect()
    assert sorted(map(tuple, got), key=str) == [("sa", "C", "p1", None, None, None, None), ("sb", "C", "p2", None, None, 2, None)]


def test_enrichment_fills_vacant_keys_only(spark):
    df = spark.createDataFrame([("x", None, None, 1.0), ("x", "L", {"k": "own"}, 0.0), ("y", None, {"k": "own"}, 0.5), ("x", "L", {"k": "own", "m": "own"}, 0.25), (None, None, None, None)], "id string, label string, properties map<string,string>, confidence double")
    got = enrich(df, [Resolver(F.col("id") == "x", {"k": "a", "m": "b"}, 0.5, "New")]).collect()
    assert [(r.id, r.label, r.properties, r.confidence, r.enriched) for r in got] == [("x", "New", {"k": "a", "m": "b"}, 0.75, True), ("x", "L", {"k": "own", "m": "b"}, 0.25, True), ("y", None, {"k": "own"}, 0.5, False), ("x", "L", {"k": "own", "m": "own"}, 0.25, False), (None, None, {}, None, False)]


def test_events_as_documents(spark):
    df = spark.createDataFrame([("urn:e", 'x"\\\n', None)], "id string, a string, b string")
    given = {"action": F.col("a"), "bizStep": F.col("b"), "batchNumber": F.lit(7)}
    r = df.select(event_turtle(F.col("id"), F.lit("ObjectEvent"), given).alias("t"), event_jsonld(F.col("id"), F.lit("ObjectEvent"), given).alias("j")).withColumn("d", document(F.array("j", "j"), F.lit("1997-01-01T00:00:00Z"))).first()
    assert r.t.endswith('<urn:e>\n    a epcis:ObjectEvent ;\n    epcis:action "x\\"\\\\\\n" ;\n    milk:batchNumber "7"^^xsd:decimal .\n')
    event = json.loads(r.j)
    assert event["@id"] == "urn:e" and event["epcis:action"] == 'x"\\\n' and "epcis:bizStep" not in event and event["milk:batchNumber"] == "7"
    assert json.loads(r.d)["epcisBody"]["eventList"] == [event, event]
