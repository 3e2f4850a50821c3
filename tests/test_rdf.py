from pyspark.sql import functions as F
import pytest

from quarry.functions.strings import edit_similarity, midnight, phonetic, token_jaccard
from quarry.operators import bgp, closure, ledger, linking, shapes, trace
from quarry.sources import quads as Q

TURTLE = """
@prefix t: <http://ex.org/t#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
t:b1 a t:Batch ; t:id "B1" ; t:from t:farm ; t:note "say \\"hi\\"\\n"@en , 'x' ; t:qty 2.5 ; t:at "2024-01-01T00:00:00Z"^^xsd:dateTime .
t:b2 a t:SpecialBatch ; t:id "B1" , "B2" ; t:from [ t:lat "1.0" ] ; t:parts ( 1 2 ) ; t:ok true .
t:SpecialBatch rdfs:subClassOf t:Batch .
t:farm t:in t:region . t:region t:in t:land .
"""
T = "http://ex.org/t#"


@pytest.fixture(scope="module")
def quads(spark):
    rows = spark.createDataFrame([("urn:g1", TURTLE), ("urn:g2", "this is not turtle")], "g string, text string")
    return Q.parse_turtle(rows).cache()


def test_turtle(quads):
    got = {(r.s, r.p, r.o, r.o_kind, r.o_dt, r.o_lang) for r in quads.where("g = 'urn:g1'").collect()}
    assert (T + "b1", T + "note", 'say "hi"\n', "literal", Q.RDF + "langString", "en") in got
    assert (T + "b1", T + "qty", "2.5", "literal", Q.XSD + "decimal", None) in got
    assert (T + "b1", Q.RDF + "type", T + "Batch", "iri", None, None) in got
    assert sum(p == Q.RDF + "first" for _, p, *_ in got) == 2 and len(got) == 21
    assert [r.o for r in quads.where("g = 'urn:g2'").collect()] == ["this is not turtle"]


def test_strict(spark):
    with pytest.raises(Exception, match="Turtle"):
        Q.parse_turtle(spark.createDataFrame([("g", "a b")], "g string, text string"), strict=True).collect()


def test_nquads_round_trip(spark, quads, tmp_path):
    Q.write_nquads(quads, f"{tmp_path}/nq")
    back = Q.read_nquads(spark, f"{tmp_path}/nq")
    plain = lambda df: {tuple(None if v == Q.RDF + "langString" else v for v in r) for r in df.select(*Q.COLUMNS).collect()}
    assert plain(back) == plain(quads)
    assert Q.parse_nquads(spark.createDataFrame([("# x",), ("",), ("<a> <b> .",), ('<a> <b> "c\\\\n" .',)], "value string")).collect()[0].o == "c\\n"


def test_match(quads):
    found = bgp.match(quads, [bgp.Pattern("?b", T + "from", "?f"), bgp.Pattern("?b", T + "id", "?id")], [[bgp.Pattern("?f", T + "in", "?r")]])
    assert sorted((r.b[-2:], r.id, r.r) for r in found.collect()) == [("b1", "B1", T + "region"), ("b2", "B1", None), ("b2", "B2", None)]
    with pytest.raises(ValueError):
        bgp.match(quads, [bgp.Pattern("?a", T + "id", "?x"), bgp.Pattern("?b", T + "in", "?y")])
    assert bgp.describe(quads, T + "farm").count() == 2
    assert {r.s[-2:]: r.id for r in bgp.star(quads, {"id": T + "id", "qty": T + "qty"}, ["id"]).collect()} == {"b1": "B1", "b2": "B1"}


def test_shapes(quads):
    rules = [shapes.Property(T + "id", 1, 1), shapes.Property(T + "qty", 1, datatype="integer"), shapes.Property(T + "from", node_kind="iri")]
    got = {(r.s[-2:], r.path[-3:].strip("#"), r.problem) for r in shapes.validate(quads, T + "Batch", rules).collect()}
    assert got == {("b2", "id", "maxCount"), ("b2", "qty", "minCount"), ("b1", "qty", "datatype"), ("b2", "rom", "nodeKind")}
    assert [(r.s, r.o) for r in shapes.chain(quads, [T + "from", T + "in", T + "in"], T + "land").collect()] == [(T + "b1", T + "land")]
    assert shapes.duplicate_keys(quads.unionByName(quads.where(F.col("s") == T + "b1").withColumn("s", F.lit("c"))), [T + "id"]).count() == 1


def test_trace(quads):
    hops = {(r.hop, r.o[-6:]) for r in trace.frontier_trace(quads, T + "b1").collect()}
    assert (1, "t#farm") in hops and (2, "region") in hops and (3, "t#land") in hops
    assert trace.products(quads, T + "Batch", {"id": T + "id"}, search="b1").count() == 1
    assert trace.related(quads, T + "b1", [T + "id"]).count() == 1
    assert [r.n for r in trace.steps(quads, T + "from", T + "at", {"id": T + "id"}).orderBy("product", "n").collect()][:1] == [1]


def test_ledger(quads, spark):
    root = ledger.merkle_root(quads.select(ledger.quad_hash().alias("hash"))).first().root
    again = ledger.merkle_root(quads.repartition(3).select(ledger.quad_hash().alias("hash"))).first().root
    assert root == again and len(root) == 64
    assert ledger.merkle_root(quads.limit(0).select(ledger.quad_hash().alias("hash"))).first().root == "0" * 64
    renamed = quads.withColumn("o", F.when(F.col("o_kind") == "bnode", F.concat(F.lit("z"), "o")).otherwise(F.col("o"))).withColumn("s", F.when(F.col("s_kind") == "bnode", F.concat(F.lit("z"), "s")).otherwise(F.col("s")))
    assert {tuple(r) for r in ledger.graph_hash(quads).collect()} == {tuple(r) for r in ledger.graph_hash(renamed).collect()}
    assert [(r.low, r.high) for r in ledger.gaps(spark.createDataFrame([(1,), (2,), (5,), (2_000_000,)], "i long"), "i").orderBy("low").collect()] == [(0, 0), (3, 4), (6, 1_999_999)]


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    assert {(r.node, r.dist) for r in closure.reach(edges, spark.createDataFrame([(1,)], "start long")).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert closure.has_cycle(edges).first().has_cycle and not closure.has_cycle(edges.where("src <> 3")).first().has_cycle
    assert {r.node: r.component for r in closure.weak_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert sorted(map(tuple, (r.nodes for r in closure.bounded_paths(edges, spark.createDataFrame([(1,)], "start long"), 5).collect()))) == [(1, 2), (1, 2, 3), (1, 2, 3, 4)]


def test_linking(spark):
    rows = spark.createDataFrame([(1, "x", "Green Farm"), (2, "x", "green farm"), (3, "x", "Green Farms"), (4, "y", "Green Farm"), (5, "x", "Blue")], "id long, block string, name string")
    pairs = linking.linked_pairs(rows, 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    entities = linking.merged(rows, pairs)
    assert {r.id: r.entity for r in entities.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    edges = spark.createDataFrame([(2, "p", 4), (3, "p", 4), (1, "q", 3)], "src long, p string, dst long")
    assert [tuple(r) for r in linking.rewired(edges, entities).collect()] == [(1, "p", 4)]


def test_strings(spark):
    one = spark.range(1).select(*[phonetic(F.lit(w)).alias(w or "none") for w in ("Robert", "Ashcraft", "Tymczak", "")], edit_similarity(F.lit("kitten"), F.lit("sitting")).alias("e"), token_jaccard(F.lit(""), F.lit(" ")).alias("j"), midnight(F.lit("20240229")).alias("d"), midnight(F.lit("20230229")).alias("bad")).first()
    assert (one.Robert, one.Ashcraft, one.Tymczak, one.none) == ("R163", "A226", "T522", "0000")
    assert one.e == pytest.approx(1 - 3 / 7) and one.j == 1.0 and one.d == "2024-02-29T00:00:00Z" and one.bad is None
