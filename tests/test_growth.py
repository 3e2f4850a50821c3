"""What must not grow with the square of a group: found by taking away the steps that do."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from quarry.operators import ontology, pointers
from quarry.operators.linking import grouped, linked_pairs
from quarry.operators.stage import stored
from quarry.plans import patterns, records


def no_pairs(*_):
    raise AssertionError("pairs are formed")


def test_groups_form_no_pairs(spark, monkeypatch):
    rows = spark.range(300).select("id", F.lit("b").alias("block"), F.when(F.col("id") % 3 == 0, "Small ring").when(F.col("id") % 3 == 1, "small ring").when(F.col("id") > 250, None).otherwise("bolt").alias("name"))
    pairs = {(r.a, r.b) for r in linked_pairs(rows, 0.8).select("a", "b").collect()}
    names = {i: None if i > 250 and i % 3 == 2 else "bolt" if i % 3 == 2 else "ring" for i in range(300)}
    assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if names[i] and names[i] == names[j]}
    assert {tuple(r) for r in grouped(rows, 0.8).collect()} == {(i, {"ring": 0, "bolt": 2}.get(n, i)) for i, n in names.items()}
    monkeypatch.setattr(records, "linked_pairs", no_pairs)
    assert entry_points.queries()["entity_groups"](spark, "/root/testdata/sf0.001").count() == 200


@pytest.mark.parametrize("repeats", [1, 2])
def test_paths_form_no_pairs(spark, tmp_path, monkeypatch, repeats):
    orders = spark.range(30).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4).alias("o_custkey"), F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0)").alias("o_orderdate"))
    for _ in range(repeats):
        orders.write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    if repeats == 1:
        monkeypatch.setattr(patterns, "reach", no_pairs)
    found = {tuple(r)[:2] for r in entry_points.queries()["path_plus"](spark, str(tmp_path)).collect()}
    later = {k: len(range(k, 30, 4)) - 1 for k in range(30)}
    assert found == ({(k, n) for k, n in later.items() if n} if repeats == 1 else {(k, n + 1) for k, n in later.items()})


def test_rounds_go_by_numbers(spark, monkeypatch):
    named = []
    monkeypatch.setattr(pointers, "stored", lambda df: (named.append(any(t == "string" for _, t in df.dtypes)), stored(df))[1])
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", None)], "node string, next string")
    found = pointers.members(links, links.where("node in ('n0', 'n30')").select(F.col("node").alias("head")))
    assert {tuple(r) for r in found.collect()} == {("n0", f"n{i}", i) for i in range(41)} | {("n30", f"n{i}", i - 30) for i in range(30, 41)}
    assert sum(named) == 2


def most_rows(frame):
    """The most rows that a step of the frame's plan gave, once it has run without adaptive steps."""
    frame.collect()

    def each(node):
        rows = node.metrics().get("numOutputRows")
        kids = node.children()
        return max([rows.get().value() if rows.isDefined() else 0, *[each(kids.apply(k)) for k in range(kids.size())]])

    return each(frame._jdf.queryExecution().executedPlan())


def test_repeated_quads_of_a_shape_make_no_pairs(spark):
    sh = ontology.SHACL
    kinds = [("urn:s", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", sh + "NodeShape"), ("urn:s", sh + "targetClass", "urn:c")]
    quads = spark.range(200).selectExpr("'g' as g", "explode(array(" + ", ".join(f"struct('{s}' as s, '{p}' as p, '{o}' as o)" for s, p, o in kinds) + f", struct('urn:s' as s, '{sh}property' as p, concat('_:', id) as o), struct(concat('_:', id) as s, '{sh}path' as p, 'urn:p' as o))) as q").select("g", "q.*")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = ontology.shapes(quads)
        assert most_rows(found) <= 800  # the quads
        assert [tuple(r) for r in found.collect()] == [("urn:s", "urn:c", "urn:p", None, None, None, None)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
