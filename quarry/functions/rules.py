"""Scoring rules as columns: what a batch, a supplier, a check or an activity amounts to."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kg of CO2 a kg of product by way of production, a tonne-kilometre by means of transport, a kg of packaging.
PRODUCTION = {"organic": 1.2, "sustainable": 1.5, "conventional": 2.0, "intensive": 2.8}
TRANSPORT = {"electric_truck": 0.08, "rail": 0.05, "ship": 0.01, "truck": 0.12, "air": 0.50, "plane": 0.50}
PACKAGING = {"none": 0.0, "minimal": 0.05, "paper": 0.10, "cardboard": 0.15, "plastic": 0.25, "glass": 0.30, "metal": 0.40, "composite": 0.35}
# Kilometres of a transport, kg of packaging, kWh a kg of product and kg of CO2 a kWh saved.
KILOMETRES, PACKAGED, KWH, SAVED = 1000.0, 0.05, 10.0, 0.5
# Words of a predicate or text and the kind of transaction they tell of, in the order in which they are tried.
KINDS = ["Production", "Processing", "Transport", "Quality", "Transfer", "Environmental", "Compliance", "Governance"]
DATA_WORDS = [("production", "Production"), ("processing", "Processing"), ("transport", "Transport"), ("quality", "Quality"), ("transfer", "Transfer"), ("environment", "Environmental"), ("compliance", "Compliance")]
PREDICATE_WORDS = [("production", "Production"), ("process", "Processing"), ("transport", "Transport"), ("ship", "Transport"), ("logistics", "Transport"), ("quality", "Quality"), ("test", "Quality"), ("transfer", "Transfer"), ("owner", "Transfer"), ("environment", "Environmental"), ("carbon", "Environmental"), ("co2", "Environmental"), ("temperature", "Environmental"), ("humidity", "Environmental"), ("compliance", "Compliance"), ("regulation", "Compliance"), ("certificate", "Compliance"), ("audit", "Compliance"), ("governance", "Governance"), ("policy", "Governance")]


def factor(key: Column, values: dict[str, float], default: float) -> Column:
    """The value of key, or the default for null and unknown keys."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(default))


def points(base: float, *rules: Column) -> Column:
    """base and what each rule adds, 1 at most. A rule without a value adds nothing."""
    total = F.lit(base)
    for rule in rules:
        total = total + F.coalesce(rule.cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.round(total, 9))


def worded(text: Column, words: list[tuple[str, str]], default: str) -> Column:
    """The kind of the first word that text holds, whatever its case."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(word), F.lit(kind)) for word, kind in words], F.lit(default))


def production_emissions(kg: Column, method: Column) -> Column:
    return kg * factor(method, PRODUCTION, PRODUCTION["conventional"])


def transport_emissions(kg: Column, mode: Column) -> Column:
    return F.lit(KILOMETRES) * factor(mode, TRANSPORT, TRANSPORT["truck"]) * (kg / 1000.0)


def packaging_emissions(kg: Column, kind: Column) -> Column:
    return kg * F.lit(PACKAGED) * factor(kind, PACKAGING, PACKAGING["plastic"])


def carbon_offsets(kg: Column, direct: Column, renewable_percent: Column) -> Column:
    """What is offset directly, and what renewable energy saves."""
    renewable = F.when(renewable_percent > 0, kg * KWH * (renewable_percent / 100.0) * SAVED)
    return F.coalesce(direct, F.lit(0.0)) + F.coalesce(renewable, F.lit(0.0))


def supplier_risk(history: Column, certified: Column, origin: Column) -> Column:
    known = F.coalesce(history, F.lit(0))
    return points(0.1, F.when(known == 0, 0.3).when(known < 10, 0.1), F.when(~F.coalesce(certified, F.lit(False)), 0.2), F.when(~origin.isin("US", "USA", "local"), 0.1))


def transport_risk(mode: Column, temperature_min: Column, hours: Column) -> Column:
    mode = F.coalesce(mode, F.lit("truck"))
    by_mode = F.when(mode.isin("rail", "ship"), 0.0).when(mode == "truck", 0.05).when(mode.isin("air", "plane"), 0.25).otherwise(0.10)
    return points(0.15, by_mode, F.when(temperature_min.isNotNull(), 0.10), F.when(hours > 48, 0.10).when(hours > 24, 0.05))


def quality_risk(product: Column, age_days: Column, checked: Column) -> Column:
    has = lambda *words: F.coalesce(F.lower(product).rlike("|".join(words)), F.lit(False))
    kind = F.when(has("fresh", "dairy", "meat"), 0.15).when(has("frozen"), 0.10).when(has("organic"), 0.05)
    return points(0.1, kind, F.when(age_days > 30, 0.15).when(age_days > 14, 0.08).when(age_days < 1, 0.02), F.when(~checked, 0.20))


def environmental_risk(location: Column, method: Column, stored: Column) -> Column:
    has = lambda *words: F.coalesce(F.lower(location).rlike("|".join(words)), F.lit(False))
    return points(0.15, F.when(has("flood", "drought"), 0.20).when(has("tropical"), 0.10), F.when(~F.coalesce(method == "organic", F.lit(False)), 0.15), F.when(~stored, 0.10))


def risk_level(score: Column) -> Column:
    return F.when(score < 0.25, "Low").when(score < 0.5, "Medium").when(score < 0.75, "High").otherwise("Critical")


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.7, "Good").when(score >= 0.5, "Fair").otherwise("Poor")


def quality_score(score: Column, result: Column) -> Column:
    """A score that reads as a number, else what the result's word is worth."""
    word = F.lower(result)
    by_word = F.when(word.isin("passed", "pass"), 0.95).when(word.isin("failed", "fail"), 0.25).when(word.isin("partial", "conditional"), 0.60).otherwise(0.70)
    return F.coalesce(score.try_cast("double"), by_word)


def certificate_valid(expiry: Column, as_of: Column) -> Column:
    """Whether it expires after as_of; without a date that can be read it does not expire."""
    return F.coalesce(F.try_to_timestamp(expiry) > as_of, F.lit(True))


def activity_compliant(kind: Column, documented: Column, temperature_min: Column, product: Column, status: Column) -> Column:
    papers = documented.isNull() & kind.isin("TransportActivity", "ProcessingActivity")
    warm = temperature_min.isNull() & F.coalesce(product.rlike("fresh|perishable"), F.lit(False))
    return ~(papers | warm | F.coalesce(F.lower(status) != "compliant", F.lit(False)))


def batch_quality_risk(product: Column, age_days: Column, failed: Column) -> Column:
    fresh = F.coalesce(F.lower(product).rlike("fresh|perishable"), F.lit(False))
    return points(0.0, F.when(age_days > 60, 0.30).when(age_days > 30, 0.15).when(age_days > 14, 0.05), F.when(failed, 0.40), F.when(fresh, 0.15))


def issue_type(risk: Column) -> Column:
    return F.when(risk > 0.7, "Critical Quality Failure").when(risk > 0.5, "Quality Degradation").when(risk > 0.3, "Minor Quality Issues").otherwise("Quality Monitoring Required")


def issue_severity(risk: Column) -> Column:
    return F.when(risk > 0.7, "High").when(risk > 0.4, "Medium").otherwise("Low")


def supplier_quality_risk(certified: Column, kind: Column, location: Column, quality_rate: Column) -> Column:
    by_kind = F.when(kind == "Manufacturer", 0.05).when(kind == "LogisticsProvider", 0.10).when(kind.isin("Farmer", "Producer"), 0.15).otherwise(0.10)
    abroad = ~F.coalesce(F.lower(location).rlike("local|us"), F.lit(False))
    return points(0.0, F.when(~F.coalesce(certified, F.lit(False)), 0.30), by_kind, F.when(abroad, 0.15), F.when(quality_rate < 0.90, 0.20).when(quality_rate < 0.95, 0.10))


def forecast(base: Column, day: Column, season: Column, growth: float = 0.02, noise: float = 0.1) -> Column:
    """Demand of a day: base, trend, season, and a wave of the given height."""
    return base * (1 + growth * day) * season * (1 + noise * F.sin(day * 0.5))


def season(day_of_year: Column) -> Column:
    return 1 + 0.2 * F.sin(2 * math.pi * (day_of_year / 365))


def accuracy(cv: Column, points_: Column) -> Column:
    """Forecast accuracy from the coefficient of variation; .75 for fewer than ten points."""
    by_cv = F.when(cv < 0.1, 0.95).when(cv < 0.3, 0.85 - (cv - 0.1) * 1.25).when(cv < 0.6, 0.70 - (cv - 0.3) * 0.67).otherwise(0.50 - (cv - 0.6) * 0.25)
    return F.when(points_ < 10, 0.75).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(0.98), by_cv)))


def may_see(visibility: Column, actor: Column, owner: Column) -> Column:
    """public: all; restricted: the owner and the auditor; private: the owner; anything else has no answer."""
    v = F.lower(F.trim(visibility))
    own = actor == owner
    return F.when(v == "public", True).when(v == "restricted", own | (actor == "AuditorMSP")).when(v == "private", own)


def may_do(operation: Column, kind: Column) -> Column:
    """Whether an operation on data of a kind is allowed."""
    usual = operation.isin("read", "write", "delete")
    return F.when(kind == "Personal", usual | (operation == "export")).when(kind.isin("Confidential", "Restricted"), usual).otherwise(True)


def next_tier(tier: Column, days: Column, warm: int = 7, cold: int = 30, archive: int = 90) -> Column:
    """The tier that data moves to after so many days without access, or null."""
    return F.when((tier == "Hot") & (days > warm), "Warm").when((tier == "Warm") & (days > cold), "Cold").when((tier == "Cold") & (days > archive), "Archive")


def worsened(metric: Column, before: Column, now: Column) -> Column:
    """Percent by which a metric is worse: times, memory, processor and disk when higher, all others when lower."""
    higher = F.lower(metric).rlike("time|latency|memory|cpu|disk")
    return F.when(before != 0, F.when(higher, now - before).otherwise(before - now) / before * 100)


def severity(percent: Column) -> Column:
    return F.when(percent >= 50, "critical").when(percent >= 30, "high").when(percent >= 20, "medium").otherwise("low")


def milk_type(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("skim"), "Skimmed").when(low.contains("semi"), "Semi-Skimmed").when(low.contains("organic"), "Organic").otherwise("Whole")


def security_level(status: Column) -> Column:
    return F.when(F.lower(F.coalesce(status, F.lit(""))).contains("shortage"), "High").otherwise("Standard")


def comparison_status(systems: Column, successful: Column) -> Column:
    """What a comparison of so many systems, of which so many had a successful run, is worth."""
    return F.when(systems == 0, "no-data").when(systems == 1, "single-system-contract").when(successful == systems, "valid-comparison").when(successful > 0, "partial-comparison").otherwise("invalid-comparison")
