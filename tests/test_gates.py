"""Why queries are refused, and what transactions break, against worked cases."""

from pyspark.sql import functions as F

from quarry.functions import gates


def test_query_problems(spark):
    cases = [("select ?s { ?s ?p ?o }", None), ("# insert\nPREFIX delete: <urn:drop#>\nBASE <urn:load>\n ASK { ?s delete:p 'please add' }", None), ("SELECT ?add { ?add <http://x/drop> $clear }", None), ("DELETE WHERE { ?s ?p ?o }", "update DELETE"), ("SELECT * { } ; drop all", "update DROP"), ("", "form"), (None, None), ("describe <urn:a>", None), ("explain", "form")]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(gates.query_problem(F.col("t")).alias("p"), gates.query_problem(F.col("t"), ("SELECT",)).alias("only")).collect()
    assert [r["p"] for r in got] == [w for _, w in cases]
    assert got[1]["only"] == got[7]["only"] == "form" and got[0]["only"] is None


def test_features(spark):
    texts = ["SELECT", "a.b.c.d.e", "sum { {", "optional union count join { { }", "group by"]
    rows = [r.asDict() for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(n) for n, c in gates.query_features(F.col("t")).items()]).collect()]
    assert [(r["score"], r["level"]) for r in rows] == [(0, "Simple"), (2, "Simple"), (7, "Complex"), (14, "Very Complex"), (3, "Moderate")]
    assert rows[1]["joins"] and not rows[0]["joins"] and rows[2]["subquery"]


def test_transactions(spark):
    cases = [("Production", 0, [], None, None, 1, "outputs"), ("Production", 0, [1.0], None, None, 1, None), ("Processing", 1, None, None, None, 1, "inputs and outputs"), ("Transfer", 2, [1.5, 0.5], None, None, 1, None), ("Transfer", 1, [2000.0], None, None, 1, "signatures"), ("Transfer", 1, [2000.0], None, None, 2, "balance"), ("Quality", 1, [], None, None, 1, "quality data"), ("Quality", 1, [], "a CERTIFICATION", None, 1, "signatures"), ("Compliance", 1, [], None, None, 2, "compliance info"), ("Other", 0, None, None, None, 1, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, n long, v array<double>, test string, info string, signed long, want string")
    got = rows.select("i", gates.transaction_problem(*[F.col(c) for c in ("kind", "n", "v", "test", "info", "signed")]).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [c[-1] for c in cases]
