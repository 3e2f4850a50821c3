"""Rules against worked numbers."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.functions.strings import sanitized


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("mode", "kg"), [("rail", 50.0), ("ship", 10.0), ("air", 500.0), ("plane", 500.0), ("electric_truck", 80.0), ("truck", 120.0), (None, 120.0), ("barge", 120.0)])
def test_transport(spark, mode, kg):
    assert value(spark, R.transport_emissions(F.lit(1000.0), text(mode))) == pytest.approx(kg)


def test_emissions(spark):
    assert value(spark, R.production_emissions(F.lit(10.0), text("organic"))) == pytest.approx(12)
    assert value(spark, R.packaging_emissions(F.lit(100.0), text("glass"))) == pytest.approx(1.5)
    assert value(spark, R.carbon_offsets(F.lit(2.0), F.lit(3.0), F.lit(50.0))) == pytest.approx(8)
    assert value(spark, R.carbon_offsets(F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0))) == 0


def test_risks(spark):
    none = F.lit(None)
    assert value(spark, R.supplier_risk(none.cast("int"), none.cast("boolean"), text("DE"))) == pytest.approx(0.7)
    assert value(spark, R.transport_risk(text("air"), F.lit(4.0), F.lit(50.0))) == pytest.approx(0.6)
    assert value(spark, R.quality_risk(text("Fresh milk"), F.lit(31), F.lit(False))) == pytest.approx(0.6)
    assert value(spark, R.environmental_risk(text("Flood plain"), text("intensive"), F.lit(False))) == pytest.approx(0.6)
    assert [value(spark, R.risk_level(F.lit(x))) for x in (0.1, 0.25, 0.5, 0.75)] == ["Low", "Medium", "High", "Critical"]
    assert [value(spark, R.quality_band(F.lit(x))) for x in (0.9, 0.7, 0.5, 0.4)] == ["Excellent", "Good", "Fair", "Poor"]


def test_scores(spark):
    cases = [("0.8", "fail", 0.8), ("n/a", "PASS", 0.95), (None, "failed", 0.25), (None, "partial", 0.6), (None, "who knows", 0.7), (None, None, 0.7)]
    assert [value(spark, R.quality_score(text(s), text(r))) for s, r, _ in cases] == [x for *_, x in cases]
    assert [value(spark, R.certificate_valid(text(x), F.lit("2024-01-01").cast("timestamp"))) for x in (None, "never", "2023-12-31", "2024-01-02")] == [True, True, False, True]


@pytest.mark.parametrize(("cv", "n", "want"), [(0.05, 20, 0.95), (0.2, 20, 0.725), (0.4, 20, 0.633), (0.8, 20, 0.45), (9.0, 20, 0.25), (0.05, 9, 0.75)])
def test_accuracy(spark, cv, n, want):
    assert value(spark, R.accuracy(F.lit(cv), F.lit(n))) == pytest.approx(want)


def test_policies(spark):
    see = lambda v, a: value(spark, R.may_see(text(v), text(a), text("Org1")))
    assert [see("public", "Org2"), see(" Restricted", "AuditorMSP"), see("restricted", "Org2"), see("private", "AuditorMSP"), see("private", "Org1"), see("other", "Org1")] == [True, True, False, False, True, None]
    assert [value(spark, R.may_do(text(o), text(k))) for o, k in (("export", "Personal"), ("export", "Restricted"), ("share", "Personal"), ("share", "Public"))] == [True, False, False, True]


@pytest.mark.parametrize(("html", "want"), [("<b>Bold</b> text", "bold text"), ("open <a href", "open"), ("3 > 2", "3 2"), ("a\x85b\x00c", "abc"), ("x   y\n", "x y"), (None, None), ("", "")])
def test_sanitized(spark, html, want):
    assert value(spark, sanitized(text(html))) == want


@pytest.mark.parametrize(("limit", "want"), [(5, "aé"), (3, "aé"), (2, "a"), (6, "aé日"), (0, "")])
def test_sanitized_bytes(spark, limit, want):
    assert value(spark, sanitized(F.lit("Aé日"), limit)) == want
