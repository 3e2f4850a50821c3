"""Campaign trees, required properties, cardinalities, linking of names with characters of several bytes, merged records and pages."""

import json
import statistics

from pyspark.sql import functions as F

from quarry.functions import fields
from quarry.operators import endpoints, rules
from quarry.operators.chains import ZEROS, audited, completeness
from quarry.operators.knowledge import Kind, entities, items_json, property_graph, temporal_edges
from quarry.operators.linking import linked_pairs, merged_records
from quarry.operators.lists import FIRST, HAS_KEY, NIL, REST, class_keys, key_violations
from quarry.sources.campaign import KEYS, read_campaign, summarized


def test_campaign_tree(spark, tmp_path):
    want = {}
    for epoch in ("epoch-001", "epoch-002"):
        for run in ("r1", "r2"):
            folder = tmp_path / "epochs" / epoch / "runs" / f"{epoch}-{run}"
            folder.mkdir(parents=True)
            lines = [",".join([*KEYS, "success", "duration_ms", "operations_per_second", "metadata_json"])]
            for i in range(9):
                meta = json.dumps({"explanation_support": "full" if epoch == "epoch-001" else "none", "native_semantic_support": "yes"}).replace('"', '""')
                lines.append(f'f,s,t{i % 2},sys,,p,m,ms,{"true" if i % 4 else "FALSE"},{i * 1.5 if i != 5 else "bad"},{i},"{meta}"')
                if i % 4 and i != 5:
                    want.setdefault(f"t{i % 2}", []).append(i * 1.5)
            (folder / "benchmark_results.csv").write_text("\n".join(lines))
    rows = read_campaign(spark, str(tmp_path))
    assert {(r["epoch"], r["run"]) for r in rows.collect()} == {(e, f"{e}-{r}") for e in ("epoch-001", "epoch-002") for r in ("r1", "r2")}
    got = {r["test_name"]: r for r in summarized(rows).collect()}
    for name, values in want.items():
        r, v = got[name], sorted(values)
        assert (r["mean_ms"], r["median_ms"], r["p95_ms"], r["p99_ms"]) == (statistics.mean(v), statistics.median(v), v[round((len(v) - 1) * 0.95)], v[round((len(v) - 1) * 0.99)])
        assert (r["epochs_observed"], r["runs_observed"], r["explanation_support"], r["native_semantic_support"], r["external_semantic_stages"], r["fairness_label"]) == (2, 4, "mixed", "yes", "", "")
    assert got["t0"]["failed_count"] == 12 and got["t1"]["failed_count"] == 0 and got["t1"]["samples"] == 16


def test_names_of_several_bytes(spark):
    rows = spark.createDataFrame([(1, "b", "ééééé"), (2, "b", "ééééééé"), (3, "b", "日本語の会社"), (4, "b", "日本語の会社員"), (5, "b", "abcde"), (6, "b", "abcdefg"), (7, "c", "ééééé")], "id long, block string, name string")
    assert sorted((r["a"], r["b"]) for r in linked_pairs(rows, 0.8).collect()) == [(1, 2), (3, 4)]


def test_field_signs(spark):
    got = spark.createDataFrame([("http://a b",), ("http://a",), ("<b>",), ("my script",), ("Script",), ("no way",)], "v string").select(fields.unlike(F.col("v"), fields.URI).alias("uri"), fields.scripted(F.col("v")).alias("xss")).collect()
    # of `http://a` the first pattern wants one character more, the second takes it
    assert [(r["uri"], r["xss"]) for r in got] == [(False, False), (False, False), (True, True), (True, True), (True, False), (True, False)]


def test_merged_records(spark):
    made = spark.createDataFrame([(1, "k", "low", {"a": "1", "b": "1"}, 0.2), (2, "k", "high", {"b": "2"}, 0.9), (3, "k", "none", None, None), (4, "k", "alone", {}, 1.5)], "id long, kind string, label string, properties map<string,string>, confidence double")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, entity long")
    got = {r["id"]: r for r in merged_records(made, groups).collect()}
    assert set(got) == {2, 4} and got[2]["label"] == "high" and got[2]["properties"] == {"a": "1", "b": "2"} and got[2]["members"] == 3
    assert abs(got[2]["confidence"] - 0.55) < 1e-9 and got[4]["confidence"] == 1.0 and got[4]["properties"] == {}


def test_knowledge(spark):
    q = [("g", "b", "t", "x#Batch"), ("g", "b", "id", "7"), ("g", "b", "id", "3"), ("g", "b", "l", "Bee"), ("g", "a", "t", "x#Act"), ("g", "z", "t", "x#Act"), ("g", "z", "t", "x#Base"), ("g", "z", "at", "2"), ("g", "a", "at", "1"), ("g", "a2", "at", "2"), ("h", "b", "at", "1"), ("g", "m", "t", "x#Other")]
    frame = spark.createDataFrame(q, "g string, s string, p string, o string")
    got = {(r["uri"], r["kind"]): r for r in entities(frame, [Kind(("x#Batch",), {"id": "batchId"}), Kind(("x#Act",), {"at": "at"}, 0.5, labelled=False, needs="x#Base")], "t", "l").collect()}
    assert set(got) == {("b", "Batch"), ("z", "Act")} and got["b", "Batch"]["properties"] == {"batchId": "3"} and got["b", "Batch"]["label"] == "Bee" and got["z", "Act"]["label"] is None
    assert {(r["src"], r["dst"], r["at"]) for r in temporal_edges(frame, "at", "p").collect()} == {("a", "z", "2"), ("a", "a2", "2")} == {(r["src"], r["dst"], r["at"]) for r in temporal_edges(frame, "at", "p", nearest=True).collect()}
    kinds = frame.withColumn("o_kind", F.when(F.col("p") == "t", "iri").otherwise("literal"))
    nodes, links = property_graph(kinds, "t")
    assert {r["id"]: (r["types"], r["properties"]) for r in nodes.collect()}["b"] == (["Batch"], {"id": ["3", "7"], "l": ["Bee"], "at": ["1"]}) and links.collect() == []
    graph = json.loads(items_json(kinds, frame.where("s = 'b'").selectExpr("s as item")).first()["graph"])
    assert graph["nodes"][0] == {"id": "b", "properties": {"at": "1", "id": "3", "l": "Bee"}} and graph["edges"] == [{"source": "b", "target": "x#Batch", "label": "t"}]


def test_keys(spark):
    q = [("C", HAS_KEY, "l1"), ("l1", FIRST, "id"), ("l1", REST, "l2"), ("l2", FIRST, "site"), ("l2", REST, NIL), ("D", HAS_KEY, "l2"), ("E", HAS_KEY, "loop"), ("loop", FIRST, "x"), ("loop", REST, "loop"), ("F", HAS_KEY, NIL)]
    q += [(s, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "C") for s in ("i1", "i2", "i3", "i4")] + [(s, "id", "1") for s in ("i1", "i2", "i3", "x")] + [("i1", "site", "a"), ("i2", "site", "a"), ("i3", "site", "b"), ("x", "site", "a")]
    frame = spark.createDataFrame(q, "s string, p string, o string")
    assert sorted((r["class"], r["position"], r["property"]) for r in class_keys(frame).collect()) == [("C", 0, "id"), ("C", 1, "site"), ("D", 0, "site")]
    assert [(r["class"], r["a"], r["b"]) for r in key_violations(frame).collect()] == [("C", "i1", "i2")]


def test_chains(spark):
    rows = [("c", 0, "h0", ZEROS), ("c", 1, "h1", "h0"), ("c", 2, "h2", "h1"), ("c", 2, "f2", "h1"), ("c", 4, "h3", "h2"), ("c", 9, "o9", "lost"), ("c", 10, "o10", "o9"), ("d", 0, "x", "y"), ("d", 1, "y", "x"), ("c", 2, "h2", "h1"), ("e", 0, None, ZEROS)]
    frame = spark.createDataFrame(rows, "chain string, index long, hash string, previous string")
    audit = audited(frame, F.when(F.col("hash") != "f2", F.col("hash")).otherwise("bad"))
    got = {(r["chain"], r["hash"]): (r["height"], r["status"], r["fault"]) for r in audit.collect()}
    assert got == {("c", "h0"): (0, "main", None), ("c", "h1"): (1, "main", None), ("c", "h2"): (2, "main", None), ("c", "h3"): (3, "main", "place"), ("c", "f2"): (2, "fork", "hash"), ("c", "o9"): (0, "orphan", "orphan"), ("c", "o10"): (1, "orphan", "orphan"), ("d", "x"): (None, "cycle", "cycle"), ("d", "y"): (None, "cycle", "cycle"), ("e", None): (None, None, "hash")}
    whole = {r["chain"]: (r["blocks"], r["main"], r["forks"], r["orphans"], r["cycles"], r["corrupted"], r["missing"], r["whole"]) for r in completeness(audit).collect()}
    assert whole["c"] == (8, 5, 1, 2, 0, 1, 5, False) and whole["d"] == (2, 0, 0, 0, 2, 0, 0, False)


def test_pages_and_rules(spark):
    rows = spark.range(45).selectExpr("id", "id % 7 as k")
    page = endpoints.page_of(rows, [F.col("k"), F.col("id")], 3, 20).collect()
    assert len(page) == 5 and page[0]["total"] == 45 and page[0]["pages"] == 3 and page[-1]["id"] == 41
    assert endpoints.page_of(rows, [F.col("id")], 0, 1000).count() == 45 and endpoints.page_of(rows.limit(0), [F.col("id")], 1).count() == 0
    assert endpoints.status(spark.createDataFrame([(1, "2024-01-01 00:00:00")], "i long, t string").withColumn("t", F.to_timestamp("t")), "i", "t").first()["per_second"] == 0.1
    facts = [("T", rules.SUBCLASS, "r"), ("r", rules.OWL + "onProperty", "has"), ("r", rules.OWL + "onClass", "W"), ("r", rules.OWL + "maxQualifiedCardinality", "1"), ("W2", rules.SUBCLASS, "W"), ("t1", rules.RDF + "type", "T"), ("t2", rules.RDF + "type", "T"), ("w", rules.RDF + "type", "W"), ("v", rules.RDF + "type", "W2")]
    quads = spark.createDataFrame([*facts, ("t1", "has", "w"), ("t1", "has", "v"), ("t2", "has", "v"), ("t2", "has", "other")], "s string, p string, o string")
    assert [(r["s"], r["kind"], r["wanted"], r["found"]) for r in rules.qualified_violations(quads).collect()] == [("t1", "max", 1, 2)]
