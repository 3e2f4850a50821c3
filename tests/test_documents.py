"""RDF/XML and other documents, Turtle out and in, and tails of distributions, against worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import slope_p, student_p
from quarry.operators.canonical import canonical_hash
from quarry.sources.documents import normalized_turtle, ntriples, parse_documents, rdf_format, rdfxml, read_documents, read_turtle_lines, turtle_documents, write_turtle
from quarry.sources.quads import RDF, SCHEMA, parse_turtle, turtle_triples

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/" xml:base="http://e.org/doc" xml:lang="en">
  <e:Batch rdf:about="#b1" e:size="9"><e:made rdf:resource="other"/><e:note>text</e:note><e:n xml:lang="" rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:n></e:Batch>
  <rdf:Description rdf:nodeID="x"><e:has><e:Site rdf:ID="s"/></e:has><e:where rdf:parseType="Resource"><e:lat>1</e:lat></e:where><e:back rdf:nodeID="x"/></rdf:Description>
  <rdf:Seq rdf:about="urn:seq"><rdf:li rdf:resource="urn:a"/><rdf:li rdf:resource="urn:b"/></rdf:Seq>
  <rdf:Description rdf:about="urn:list"><e:items rdf:parseType="Collection"><rdf:Description rdf:about="urn:1"/><rdf:Description rdf:about="urn:2"/></e:items></rdf:Description>
</rdf:RDF>"""


def test_rdfxml():
    got = {(s, p.split("#")[-1].split("/")[-1], o, dt and dt.split("#")[-1], lang) for s, _, p, o, _, dt, lang in rdfxml(XML)}
    b = "http://e.org/doc#b1"
    assert {(b, "type", "http://e.org/Batch", None, None), (b, "size", "9", "langString", "en"), (b, "made", "http://e.org/other", None, None), (b, "note", "text", "langString", "en"), (b, "n", "5", "integer", None)} <= got
    assert {("x", "has", "http://e.org/doc#s", None, None), ("http://e.org/doc#s", "type", "http://e.org/Site", None, None), ("x", "back", "x", None, None)} <= got
    assert {("urn:seq", "_1", "urn:a", None, None), ("urn:seq", "_2", "urn:b", None, None)} <= got
    (place,) = [o for s, p, o, *_ in got if p == "where"]
    assert (place, "lat", "1", "langString", "en") in got
    firsts = {s: o for s, p, o, *_ in got if p == "first"}
    rests = {s: o for s, p, o, *_ in got if p == "rest"}
    (head,) = [o for s, p, o, *_ in got if p == "items"]
    assert (firsts[head], firsts[rests[head]], rests[rests[head]]) == ("urn:1", "urn:2", RDF + "nil") and len(got) == 18
    for bad in ("<a><b></a>", "", "no xml"):
        with pytest.raises(ValueError):
            rdfxml(bad)


def test_same_triples_from_all_formats(spark):
    turtle = '@prefix e: <http://e.org/> .\ne:a a e:T ; e:p "x\\n\\"q\\"", 5 ; e:q e:b .'
    lines = '# c\n<http://e.org/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e.org/T> .\n<http://e.org/a> <http://e.org/p> "x\\n\\"q\\"" .\n<http://e.org/a> <http://e.org/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n\n<http://e.org/a> <http://e.org/q> <http://e.org/b> .'
    xml = '<e:T xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/" rdf:about="http://e.org/a"><e:p>x\n"q"</e:p><e:p rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:p><e:q rdf:resource="http://e.org/b"/></e:T>'
    assert set(turtle_triples(turtle)) == set(ntriples(lines)) == set(rdfxml(xml))
    files = spark.createDataFrame([("t", turtle), ("n", lines), ("x", xml), ("r", "not rdf\n# c\n@prefix\nat all"), ("0", None)], "g string, text string")
    quads, counts = parse_documents(files, order=("ntriples", "rdfxml", "turtle"))
    assert {r["g"]: (r["format"], r["triples"]) for r in counts.collect()} == {"t": ("turtle", 4), "n": ("ntriples", 4), "x": ("rdfxml", 4), "r": ("raw", 2), "0": ("ntriples", 0)}
    assert {r["g"]: r["n"] for r in quads.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {"t": 4, "n": 4, "x": 4, "r": 1}
    with pytest.raises(Exception, match="no parser takes"):
        parse_documents(files, strict=True)[0].collect()
    assert parse_documents(files.limit(0))[1].collect() == []


def test_formats(spark):
    cases = [(" @prefix a: <b> .", "x", "turtle"), ("<?xml?>", "x.ttl", "rdfxml"), ("<rdf:RDF/>", "", "rdfxml"), ("# c\n<a> <b> <c> .\n", "x.rdf", "ntriples"), ("a", "d/x.NQ", "nquads"), ("a", "x.nt", "ntriples"), ("a", "x.owl", "turtle"), ("a", "noend", "turtle"), ("", "x.nq", "ntriples")]
    rows = spark.createDataFrame(cases, "text string, path string, want string").select("want", rdf_format(F.col("text"), F.col("path")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    text = "@prefix e: <http://e/> .\ne:a/b e:c f:x/y , e:d/e/f ."
    assert spark.range(1).select(normalized_turtle(F.lit(text))).first()[0].splitlines()[2:] == ["@prefix e: <http://e/> .", "<http://e/a/b> e:c f:x/y , <http://e/d/e/f> ."]


def test_turtle_out_and_in(spark, tmp_path):
    x = "http://www.w3.org/2001/XMLSchema#"
    rows = [("urn:g", "http://example.org/a", "iri", "http://example.org/p", 'q"\\ \n é', "literal", None, None), ("urn:g", "http://example.org/a", "iri", "http://example.org/p", "5", "literal", x + "integer", None), ("urn:g", "b", "bnode", "urn:p", "b", "bnode", None, None), ("urn:g", "http://example.org/a/b", "iri", "urn:p", "hola", "literal", RDF + "langString", "es"), ("urn:h", "urn:s", "iri", "urn:p", "urn:o", "iri", None, None)]
    quads = spark.createDataFrame(rows * 2, SCHEMA)
    docs = turtle_documents(quads)
    again = parse_turtle(docs)
    as_set = lambda df: {tuple(r) for r in df.select("g", "p", "o_kind", "o_dt", "o_lang", F.when(F.col("o_kind") != "bnode", F.col("o"))).collect()}
    assert as_set(again) == as_set(quads) and again.count() == 5
    hashes = lambda df: {tuple(r) for r in canonical_hash(df).collect()}
    assert hashes(again) == hashes(quads)
    text = {r["g"]: r["text"] for r in docs.collect()}["urn:g"]
    assert text.startswith("@prefix ex: <http://example.org/> .") and "ex:a ex:p " in text and "<http://example.org/a/b>" in text
    write_turtle(quads, f"{tmp_path}/out")
    lines = read_turtle_lines(spark, f"{tmp_path}/out")
    assert {(r["g"], r["s"], r["o"]) for r in lines.collect()} == {(r[0], r[1], r[4]) for r in rows}
    (tmp_path / "one.rdf").write_text(XML)
    found, counts = read_documents(spark, f"{tmp_path}/one.rdf")
    assert counts.first()["format"] == "rdfxml" and found.count() == 18
    assert turtle_documents(quads.limit(0)).collect() == []


def test_tails(spark):
    def area(t, v):
        """Both tails beyond t, by Simpson's rule."""
        f = lambda x: (1 + x * x / v) ** (-(v + 1) / 2)
        t, n = abs(t), 20_000
        inner = sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(t * k / n) for k in range(n + 1)) * t / n / 3
        return 1 - 2 * inner * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)

    known = [(2.0, 10), (1.0, 1), (12.706, 1), (1.984, 98), (0.0, 7), (-3.0, 20), (0.02, 400), (4.5, 2500)]
    got = spark.createDataFrame(known, "t double, n int").select("t", "n", student_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(abs(r["p"] - area(r["t"], r["n"])) < 1e-9 for r in got)
    rows = spark.createDataFrame([(1.0, 9), (0.0, 9), (0.5, 2), (0.9, 5)], "r double, n int").select(slope_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert rows[0]["p"] == 0 and rows[1]["p"] == 1 and rows[2]["p"] is None and abs(rows[3]["p"] - 0.0373860734) < 1e-8


def test_a_task_hands_quads_on_in_parts(spark, monkeypatch):
    import pandas as pd

    from quarry.sources import documents

    files, runs = spark.createDataFrame([("t", "")], "g string, text string"), []
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, run, schema, f=type(files).mapInPandas: (runs.append(run), f(self, run, schema))[1])
    parse_documents(files)
    text = "@prefix e: <http://e.org/> .\n" + "".join(f"e:s{k} e:p {k} .\n" for k in range(30))
    parts = list(runs[0](iter([pd.DataFrame({"g": [f"g{k}" for k in range(n)], "t": [text] * n}) for n in (700, 0, 300)])))
    assert sum(map(len, parts)) == 30_000 and max(map(len, parts)) < documents.ROWS_AT_A_TIME + 30
