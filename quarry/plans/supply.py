"""Supply-chain rules over the tables: parts as batches, line items as checks and activities, suppliers and orders as themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.plans.tables import table

#: What a part is taken for, by its key or size.
PRODUCTS = ["fresh milk", "frozen peas", "organic oats", "dairy cream", "steel bolts", "perishable fish"]
METHODS = ["organic", "sustainable", "conventional", "intensive", None]
MODES = [*R.TRANSPORT, "barge", None]
PACKS = [*R.PACKAGING, "foil", None]
ORIGINS = ["US", "USA", "local", "DE", None]
PLACES = ["Flood plain", "tropical coast", "temperate valley", None]


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _sql(values: list, at: str) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST({at} AS BIGINT) + 1]"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as batches; checked and failed tell whether a line item of the part was accepted or returned."""
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("batch")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("checked"), F.bool_or(F.col("l_returnflag") == "R").alias("failed"))
    made = p.select(key.alias("batch"), "p_name", "p_type", "p_brand", size.cast("double").alias("kg"), _pick(PRODUCTS, key % 6).alias("product"), _pick(METHODS, size % 5).alias("method"), _pick(MODES, key % 8).alias("mode"), _pick(PACKS, key % 10).alias("pack"), _pick(ORIGINS, key % 5).alias("origin"), _pick(PLACES, key % 4).alias("location"), (key % 3).cast("double").alias("direct"), (size * 3 % 100).cast("double").alias("renewable"), (size % 15).alias("history"), (key % 3 == 0).alias("certified"), F.when(F.col("p_type") == "ECONOMY", 4.0).alias("temperature_min"), F.when(size % 7 != 0, size * 2.0).alias("hours"), (key % 90).alias("age_days"), (size % 2 == 0).alias("stored"))
    return made.join(seen, "batch", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("checked", "failed")})


_BATCHES = f"""seen AS (SELECT l_partkey, bool_or(l_returnflag = 'A') AS checked, bool_or(l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1),
    b AS (SELECT p_partkey AS batch, p_name, p_type, p_brand, p_size::DOUBLE AS kg, {_sql(PRODUCTS, 'p_partkey % 6')} AS product, {_sql(METHODS, 'p_size % 5')} AS method, {_sql(MODES, 'p_partkey % 8')} AS mode,
        {_sql(PACKS, 'p_partkey % 10')} AS pack, {_sql(ORIGINS, 'p_partkey % 5')} AS origin, {_sql(PLACES, 'p_partkey % 4')} AS location, (p_partkey % 3)::DOUBLE AS direct, (p_size * 3 % 100)::DOUBLE AS renewable,
        p_size % 15 AS history, p_partkey % 3 = 0 AS certified, CASE WHEN p_type = 'ECONOMY' THEN 4.0 END AS temperature_min, CASE WHEN p_size % 7 <> 0 THEN p_size * 2 END AS hours, p_partkey % 90 AS age_days,
        p_size % 2 = 0 AS stored, coalesce(checked, false) AS checked, coalesce(failed, false) AS failed FROM part LEFT JOIN seen ON p_partkey = l_partkey)"""
_MADE = "kg * (CASE method WHEN 'organic' THEN 1.2 WHEN 'sustainable' THEN 1.5 WHEN 'intensive' THEN 2.8 ELSE 2.0 END)::DOUBLE"
_MOVED = "1000.0::DOUBLE * (CASE mode WHEN 'electric_truck' THEN 0.08 WHEN 'rail' THEN 0.05 WHEN 'ship' THEN 0.01 WHEN 'air' THEN 0.5 WHEN 'plane' THEN 0.5 ELSE 0.12 END)::DOUBLE * (kg / 1000.0::DOUBLE)"
_PACKED = "kg * 0.05::DOUBLE * (CASE pack WHEN 'none' THEN 0.0 WHEN 'minimal' THEN 0.05 WHEN 'paper' THEN 0.1 WHEN 'cardboard' THEN 0.15 WHEN 'glass' THEN 0.3 WHEN 'metal' THEN 0.4 WHEN 'composite' THEN 0.35 ELSE 0.25 END)::DOUBLE"
_OFFSET = "direct + CASE WHEN renewable > 0 THEN kg * 10.0::DOUBLE * (renewable / 100.0::DOUBLE) * 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_SUPPLIER = "least(1, 0.1 + CASE WHEN history = 0 THEN 0.3 WHEN history < 10 THEN 0.1 ELSE 0 END + CASE WHEN certified THEN 0 ELSE 0.2 END + CASE WHEN origin IN ('US', 'USA', 'local') OR origin IS NULL THEN 0 ELSE 0.1 END)::DOUBLE"
_TRANSPORT = "least(1, 0.15 + CASE coalesce(mode, 'truck') WHEN 'rail' THEN 0 WHEN 'ship' THEN 0 WHEN 'truck' THEN 0.05 WHEN 'air' THEN 0.25 WHEN 'plane' THEN 0.25 ELSE 0.1 END + CASE WHEN temperature_min IS NULL THEN 0 ELSE 0.1 END + CASE WHEN hours > 48 THEN 0.1 WHEN hours > 24 THEN 0.05 ELSE 0 END)::DOUBLE"
_QUALITY = "least(1, 0.1 + CASE WHEN product LIKE '%fresh%' OR product LIKE '%dairy%' OR product LIKE '%meat%' THEN 0.15 WHEN product LIKE '%frozen%' THEN 0.1 WHEN product LIKE '%organic%' THEN 0.05 ELSE 0 END + CASE WHEN age_days > 30 THEN 0.15 WHEN age_days > 14 THEN 0.08 WHEN age_days < 1 THEN 0.02 ELSE 0 END + CASE WHEN checked THEN 0 ELSE 0.2 END)::DOUBLE"
_ENVIRONMENT = "least(1, 0.15 + CASE WHEN lower(location) LIKE '%flood%' OR lower(location) LIKE '%drought%' THEN 0.2 WHEN lower(location) LIKE '%tropical%' THEN 0.1 ELSE 0 END + CASE WHEN method = 'organic' THEN 0 ELSE 0.15 END + CASE WHEN stored THEN 0 ELSE 0.1 END)::DOUBLE"


def carbon_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of all batches by source, each source's share, and what is offset."""
    b, kg = batches(spark, sf_dir), F.col("kg")
    parts = {"production": R.production_emissions(kg, F.col("method")), "transport": R.transport_emissions(kg, F.col("mode")), "packaging": R.packaging_emissions(kg, F.col("pack"))}
    total = b.agg(*[F.sum(F.round(v, 6).cast("decimal(18,6)")).alias(k) for k, v in parts.items()], F.sum(F.round(R.carbon_offsets(kg, F.col("direct"), F.col("renewable")), 6).cast("decimal(18,6)")).alias("offsets"))
    whole = sum((F.col(k).cast("double") for k in list(parts)[1:]), F.col("production").cast("double"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.col(k).cast("double").alias("kg")) for k in parts])).alias("e")
    return total.select("*", each).select("e.source", "e.kg", F.round(F.col("e.kg") / whole * 100, 6).alias("share"), F.col("offsets").cast("double").alias("offsets"))


def batch_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's emissions by source, its offsets and what is left."""
    b, kg = batches(spark, sf_dir), F.col("kg")
    made, moved, packed = R.production_emissions(kg, F.col("method")), R.transport_emissions(kg, F.col("mode")), R.packaging_emissions(kg, F.col("pack"))
    off = R.carbon_offsets(kg, F.col("direct"), F.col("renewable"))
    return b.select("batch", F.round(made, 6).alias("production"), F.round(moved, 6).alias("transport"), F.round(packed, 6).alias("packaging"), F.round(off, 6).alias("offsets"), F.round(made + moved + packed - off, 6).alias("net"))


def batch_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four risks of a batch, weighted .3, .2, .3 and .2, their level, and what is recommended."""
    c = F.col
    b = batches(spark, sf_dir).select("batch", R.supplier_risk(c("history"), c("certified"), c("origin")).alias("supplier"), R.transport_risk(c("mode"), c("temperature_min"), c("hours")).alias("transport"), R.quality_risk(c("product"), c("age_days"), c("checked")).alias("quality"), R.environmental_risk(c("location"), c("method"), c("stored")).alias("environment"))
    b = b.withColumn("risk", F.round(0.3 * c("supplier") + 0.2 * c("transport") + 0.3 * c("quality") + 0.2 * c("environment"), 9))
    advice = F.array_compact(F.array(F.when(c("risk") > 0.7, F.lit("attention")), *[F.when(c(k) > 0.6, F.lit(k)) for k in ("supplier", "transport", "quality", "environment")]))
    return b.select("*", R.risk_level(c("risk")).alias("level"), F.when(F.size(advice) == 0, "monitor").otherwise(F.array_join(advice, ",")).alias("advice"))


def supplier_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality .4, delivery .3, compliance .3; a supplier without a record takes .85, .90 and .95. On-time orders are at most all orders."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("done"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("issues"))
    quality, delivery = F.coalesce(1 - F.col("issues") / F.col("n"), F.lit(0.85)), F.coalesce(F.col("done") / F.col("n"), F.lit(0.90))
    compliance = F.when(F.col("s_acctbal") > 0, 1.0).when(F.col("s_acctbal") < 0, 0.5).otherwise(0.95)
    s = table(spark, sf_dir, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    s = s.select("s_suppkey", F.round(quality, 9).alias("quality"), F.round(delivery, 9).alias("delivery"), compliance.alias("compliance"), F.round(0.4 * quality + 0.3 * delivery + 0.3 * compliance, 9).alias("overall"), F.coalesce("orders", F.lit(10)).cast("long").alias("orders"), F.coalesce("done", F.lit(9)).cast("long").alias("done"))
    return s.select("s_suppkey", "quality", "delivery", "compliance", "overall", R.risk_level(F.round(1 - F.col("overall"), 9)).alias("level"), "orders", F.least("orders", "done").alias("on_time"))


def supplier_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty suppliers of the highest overall score, ties by key."""
    return supplier_performance(spark, sf_dir).select("s_suppkey", "overall").orderBy(F.desc("overall"), "s_suppkey").limit(20)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checks by band: some with a score, some with a score that is no number, some with a word only."""
    word = _pick(["Passed", "fail", "Conditional", "unclear", None], F.col("l_linenumber") % 5)
    score = F.when(F.col("l_orderkey") % 3 == 0, F.round(1 - F.col("l_discount") * 5, 4).cast("string")).when(F.col("l_orderkey") % 3 == 1, "n/a")
    s = table(spark, sf_dir, "lineitem").select(F.round(R.quality_score(score, word), 4).alias("score"))
    return s.groupBy(R.quality_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 6).alias("mean"))


def compliance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid certificates (orders) and compliant activities (line items), and their share; 1 without any."""
    o = table(spark, sf_dir, "orders").withColumn("expiry", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    certificates = o.select(R.certificate_valid(F.col("expiry"), F.lit("1997-01-01 00:00:00").cast("timestamp")).alias("ok"), F.lit("certificate").alias("source"))
    kind = _pick(["TransportActivity", "ProcessingActivity", "StorageActivity"], F.col("l_linenumber") % 3)
    product, status = _pick(PRODUCTS, F.col("l_partkey") % 6), _pick(["Compliant", "pending", None, None], F.col("l_orderkey") % 4)
    ok = R.activity_compliant(kind, F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")), F.when(F.col("l_tax") > 0.04, 4.0), product, status)
    activities = table(spark, sf_dir, "lineitem").select(ok.alias("ok"), F.lit("activity").alias("source"))
    n = certificates.unionByName(activities).agg(*[F.count(F.when(F.col("source") == s, 1)).alias(f"{s}_n") for s in ("certificate", "activity")], *[F.count(F.when((F.col("source") == s) & F.col("ok"), 1)).alias(f"{s}_ok") for s in ("certificate", "activity")])
    all_ = F.col("certificate_n") + F.col("activity_n")
    return n.select("*", F.coalesce(F.round((F.col("certificate_ok") + F.col("activity_ok")) / F.nullif(all_, F.lit(0)), 9), F.lit(1.0)).alias("rate"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by how much of them is done: full from .9, partial from .5, and the visibility and efficiency of each bucket."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.when(F.col("l_linestatus") == "F", 1)) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("hours"))
    bucket = F.when(F.col("share") >= 0.9, "full").when(F.col("share") >= 0.5, "partial").otherwise("poor")
    visible = F.least(F.lit(1.0), 0.6 * F.col("share") + 0.4 * F.least(F.lit(1.0), F.col("n") / 5))
    efficient = F.least(F.lit(1.0), 48 / F.col("hours"))
    each = o.select(bucket.alias("bucket"), F.round(visible, 6).cast("decimal(18,6)").alias("v"), F.round(efficient, 6).cast("decimal(18,6)").alias("e"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v").cast("double") / F.count(F.lit(1)), 6).alias("visibility"), F.round(F.sum("e").cast("double") / F.count(F.lit(1)), 6).alias("efficiency"))


def batch_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose quality is at risk by more than .3: what may happen, how bad, and how many measures are called for."""
    b = batches(spark, sf_dir).select("batch", R.batch_quality_risk(F.col("product"), F.col("age_days"), F.col("failed")).alias("risk")).where("risk > 0.3")
    return b.select("batch", "risk", R.issue_type(F.col("risk")).alias("issue"), R.issue_severity(F.col("risk")).alias("severity"), (1 + (F.col("risk") > 0.5).cast("int") + (F.col("risk") > 0.7).cast("int")).alias("measures"))


def supplier_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmers and manufacturers among the suppliers whose quality is at risk by more than .4."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.count(F.when(F.col("l_returnflag") != "R", 1)) / F.count(F.lit(1)), 9).alias("rate"))
    kind, place = _pick(["Farmer", "Manufacturer", "LogisticsProvider"], F.col("s_suppkey") % 3), _pick(["Local farm", "Houston, US", "Lyon", None], F.col("s_nationkey") % 4)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", kind.alias("kind"), place.alias("place")).where("kind in ('Farmer', 'Manufacturer')").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select("s_suppkey", "kind", R.supplier_quality_risk(F.col("s_acctbal") > 5000, F.col("kind"), F.col("place"), F.col("rate")).alias("risk")).where("risk > 0.4")


def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall risk of each region's chain: suppliers in debt, items at a deep discount, orders left open; fixed parts where nothing is measured."""
    share = lambda c: F.count(F.when(c, 1)) / F.count(F.lit(1))
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("nation"))
    supplier = s.groupBy("region").agg(share(F.col("s_acctbal") < 0).alias("supplier"))
    quality = table(spark, sf_dir, "lineitem").join(s.select("s_suppkey", "region"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("region").agg(share(F.col("l_discount") > 0.08).alias("quality"))
    c = table(spark, sf_dir, "customer").join(region, F.col("c_nationkey") == F.col("nation")).select("c_custkey", "region")
    compliance = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg(share(F.col("o_orderstatus") == "P").alias("compliance"))
    # The parts that stand in, and their weights.
    parts = {"supplier": (0.2, 0.4), "quality": (0.15, 0.3), "compliance": (0.1, 0.3)}
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"))
    for found in (supplier, quality, compliance):
        rows = rows.join(found, "region", "left")
    risk = sum((F.coalesce(name, F.lit(fixed)) * weight for name, (fixed, weight) in parts.items()), F.lit(0.0))
    return rows.select("region", F.round(risk, 9).alias("risk")).select("region", "risk", R.risk_level(F.col("risk")).alias("level"))


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the kind of transaction that their brand, type and product tell of; kinds without any count 0."""
    words = ["production run", "PROCESSING", "transport", "quality check", "transfer", "environmental", "compliance", "vote"]
    text = F.concat_ws(" ", F.col("p_name"), _pick(words, F.col("p_partkey") % 8))
    n = table(spark, sf_dir, "part").where("p_size <> 50 or p_partkey % 8 <> 4").groupBy(R.worded(text, R.DATA_WORDS, "Governance").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(k,) for k in R.KINDS], "kind string").join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


PREDICATES = ["urn:p#productionDate", "urn:p#processedBy", "urn:p#shippedTo", "urn:p#testResult", "urn:p#ownerOf", "urn:p#co2Level", "urn:p#auditTrail", "urn:p#policyId", "urn:p#label"]


def predicate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the kind of transaction that a predicate tells of; Processing where none does."""
    p = _pick(PREDICATES, (F.col("l_orderkey") + F.col("l_linenumber")) % 9)
    return table(spark, sf_dir, "lineitem").groupBy(p.alias("p"), R.worded(p, R.PREDICATE_WORDS, "Processing").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may see an order, asked by a customer's nation: public, restricted, private, and a word that is no visibility."""
    visibility = _pick(["public", " Restricted ", "private", "secret"], F.col("o_orderkey") % 4)
    actor = F.when(F.col("o_orderkey") % 7 == 0, "AuditorMSP").otherwise(F.concat(F.lit("Org"), F.col("c_nationkey") % 3))
    owner = F.concat(F.lit("Org"), F.col("o_custkey") % 3)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(visibility.alias("visibility"), R.may_see(visibility, actor, owner).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def data_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on data of a kind, by whether they are allowed."""
    kind = _pick(["Personal", "Confidential", "Restricted", "Internal", "Public"], F.col("user_id") % 5)
    operation = _pick(["read", "write", "delete", "export", "transform"], F.col("event_id") % 5)
    return table(spark, sf_dir, "events").groupBy(operation.alias("operation"), kind.alias("kind"), R.may_do(operation, kind).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def storage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' data by the tier that it moves to after its days without access."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.datediff(F.lit("2024-02-10").cast("date"), F.max("ts").cast("date")).alias("quiet"))
    days = F.col("quiet") + F.col("user_id") % 100
    tier = _pick(["Hot", "Warm", "Cold", "Archive"], F.col("user_id") % 4)
    return last.select("user_id", tier.alias("tier"), days.alias("days"), R.next_tier(tier, days).alias("to")).where("to is not null")


def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each event type, early against late days, as metrics that are worse when higher or lower."""
    late = F.col("event_id") % 2 == 1
    name = F.concat(F.col("event_type"), F.when(F.length("event_type") % 2 == 0, "_latency").otherwise("_rate"))
    scaled = F.when(late, F.col("value") * F.when(F.length("event_type") % 2 == 0, 1.6).otherwise(0.75)).otherwise(F.col("value"))
    mean = lambda c: F.round(F.sum(F.when(c, F.round(scaled, 4).cast("decimal(18,4)"))).cast("double") / F.count(F.when(c, 1)), 6)
    m = table(spark, sf_dir, "events").groupBy(name.alias("metric")).agg(mean(~late).alias("baseline"), mean(late).alias("current"))
    change = F.round(R.worsened(F.col("metric"), F.col("baseline"), F.col("current")), 4)
    return m.select("metric", "baseline", "current", change.alias("change")).where("change > 15").withColumn("severity", R.severity(F.col("change")))


def milk_and_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", _pick(["skimmed", "semi", "ORGANIC", None], F.col("p_partkey") % 4))
    status = _pick(["Currently in Shortage", "Resolved", None], F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").groupBy(R.milk_type(name).alias("milk"), R.security_level(status).alias("security")).agg(F.count(F.lit(1)).alias("n"))


def comparison_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as systems of a user's comparison: a system had a successful run if one of its values is above 150."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max((F.col("value") > 150).cast("int")).alias("ok"))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("systems"), F.sum("ok").alias("ok")).select("user_id", "systems", R.comparison_status(F.col("systems"), F.col("ok")).alias("status"))


def demand_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of demand with their interval of 15 %, from the mean day."""
    base = table(spark, sf_dir, "lineitem").agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.countDistinct("l_shipdate")).alias("base"))
    day = F.col("id").cast("double")
    d = spark.range(30).crossJoin(F.broadcast(base)).select(F.col("id").alias("day"), R.forecast(F.col("base"), day, R.season(day + 1)).alias("demand"))  # base is a row
    return d.select("day", F.round("demand", 4).alias("demand"), F.round(F.col("demand") * 0.85, 4).alias("low"), F.round(F.col("demand") * 1.15, 4).alias("high"))


def forecast_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event type's daily counts."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = days.groupBy("event_type").agg((F.stddev_pop("n") / F.avg("n")).alias("cv"), F.count(F.lit(1)).alias("points"))
    return g.select("event_type", F.round(R.accuracy(F.col("cv"), F.col("points")), 6).alias("accuracy"))


_LEVEL = lambda x: f"CASE WHEN {x} < 0.25 THEN 'Low' WHEN {x} < 0.5 THEN 'Medium' WHEN {x} < 0.75 THEN 'High' ELSE 'Critical' END"
_SUPPLIERS = f"""l AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS issues FROM lineitem GROUP BY 1),
    m AS (SELECT s_suppkey, coalesce(1 - issues::DOUBLE / n, 0.85::DOUBLE) AS q, coalesce(done::DOUBLE / n, 0.9::DOUBLE) AS d, (CASE WHEN s_acctbal > 0 THEN 1.0 WHEN s_acctbal < 0 THEN 0.5 ELSE 0.95 END)::DOUBLE AS c, coalesce(orders, 10) AS orders, coalesce(done, 9) AS done
        FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey),
    f AS (SELECT s_suppkey, round(q, 9) AS quality, round(d, 9) AS delivery, c AS compliance, round(0.4::DOUBLE * q + 0.3::DOUBLE * d + 0.3::DOUBLE * c, 9) AS overall, orders, least(orders, done) AS on_time FROM m)"""
_WORDED = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{k}'" for w, k in R.DATA_WORDS) + " ELSE 'Governance' END"
_PREDICATE = "CASE " + " ".join(f"WHEN contains(lower(p), '{w}') THEN '{k}'" for w, k in R.PREDICATE_WORDS) + " ELSE 'Processing' END"

QUERIES = {
    "carbon_footprint": (carbon_footprint, f"""WITH {_BATCHES}, t AS (SELECT CAST(sum(CAST(round({_MADE}, 6) AS DECIMAL(18,6))) AS DOUBLE) AS p, CAST(sum(CAST(round({_MOVED}, 6) AS DECIMAL(18,6))) AS DOUBLE) AS m, CAST(sum(CAST(round({_PACKED}, 6) AS DECIMAL(18,6))) AS DOUBLE) AS k,
        CAST(sum(CAST(round({_OFFSET}, 6) AS DECIMAL(18,6))) AS DOUBLE) AS offsets FROM b)
        SELECT 'production' AS source, p AS kg, round(p / (p + m + k) * 100, 6) AS share, offsets FROM t UNION ALL SELECT 'transport', m, round(m / (p + m + k) * 100, 6), offsets FROM t UNION ALL SELECT 'packaging', k, round(k / (p + m + k) * 100, 6), offsets FROM t"""),
    "batch_emissions": (batch_emissions, f"WITH {_BATCHES} SELECT batch, round({_MADE}, 6) AS production, round({_MOVED}, 6) AS transport, round({_PACKED}, 6) AS packaging, round({_OFFSET}, 6) AS offsets, round({_MADE} + {_MOVED} + {_PACKED} - ({_OFFSET}), 6) AS net FROM b"),
    "batch_risk": (batch_risk, f"""WITH {_BATCHES}, s AS (SELECT batch, {_SUPPLIER} AS supplier, {_TRANSPORT} AS transport, {_QUALITY} AS quality, {_ENVIRONMENT} AS environment FROM b),
        r AS (SELECT *, round(0.3::DOUBLE * supplier + 0.2::DOUBLE * transport + 0.3::DOUBLE * quality + 0.2::DOUBLE * environment, 9) AS risk FROM s)
        SELECT *, {_LEVEL('risk')} AS level, coalesce(nullif(concat_ws(',', CASE WHEN risk > 0.7 THEN 'attention' END, CASE WHEN supplier > 0.6 THEN 'supplier' END, CASE WHEN transport > 0.6 THEN 'transport' END, CASE WHEN quality > 0.6 THEN 'quality' END, CASE WHEN environment > 0.6 THEN 'environment' END), ''), 'monitor') AS advice FROM r"""),
    "supplier_performance": (supplier_performance, f"WITH {_SUPPLIERS} SELECT s_suppkey, quality, delivery, compliance, overall, {_LEVEL('round(1 - overall, 9)')} AS level, orders, on_time FROM f"),
    "supplier_ranking": (supplier_ranking, f"WITH {_SUPPLIERS} SELECT s_suppkey, overall FROM f ORDER BY overall DESC, s_suppkey LIMIT 20"),
    "quality_scores": (quality_scores, """WITH c AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN round(1 - l_discount * 5, 4) END AS score, (['Passed', 'fail', 'Conditional', 'unclear', NULL])[l_linenumber % 5 + 1] AS result FROM lineitem),
        s AS (SELECT round(coalesce(score, (CASE lower(result) WHEN 'passed' THEN 0.95 WHEN 'fail' THEN 0.25 WHEN 'conditional' THEN 0.6 ELSE 0.7 END)::DOUBLE), 4) AS score FROM c)
        SELECT CASE WHEN score >= 0.9 THEN 'Excellent' WHEN score >= 0.7 THEN 'Good' WHEN score >= 0.5 THEN 'Fair' ELSE 'Poor' END AS band, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean FROM s GROUP BY 1"""),
    "compliance_rate": (compliance_rate, f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 IN (0, 1) OR o_orderdate > TIMESTAMP '1997-01-01 00:00:00') AS ok FROM orders),
        a AS (SELECT (['TransportActivity', 'ProcessingActivity', 'StorageActivity'])[l_linenumber % 3 + 1] AS kind, l_linestatus = 'F' AS documented, l_tax > 0.04 AS cooled, {_sql(PRODUCTS, 'l_partkey % 6')} AS product, (['Compliant', 'pending', NULL, NULL])[l_orderkey % 4 + 1] AS status FROM lineitem),
        k AS (SELECT count(*) AS n, count(*) FILTER (NOT ((NOT documented AND kind <> 'StorageActivity') OR (NOT cooled AND (contains(product, 'fresh') OR contains(product, 'perishable'))) OR coalesce(lower(status) <> 'compliant', false))) AS ok FROM a)
        SELECT c.n AS certificate_n, k.n AS activity_n, c.ok AS certificate_ok, k.ok AS activity_ok, round((c.ok + k.ok)::DOUBLE / (c.n + k.n), 9) AS rate FROM c, k"""),
    "coverage": (coverage, """WITH o AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) AS share, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS hours FROM lineitem GROUP BY 1),
        e AS (SELECT CASE WHEN share >= 0.9 THEN 'full' WHEN share >= 0.5 THEN 'partial' ELSE 'poor' END AS bucket, CAST(round(least(1.0::DOUBLE, 0.6::DOUBLE * share + 0.4::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE)), 6) AS DECIMAL(18,6)) AS v, CAST(round(least(1.0::DOUBLE, 48 / hours), 6) AS DECIMAL(18,6)) AS e FROM o)
        SELECT bucket, count(*) AS n, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS visibility, round(CAST(sum(e) AS DOUBLE) / count(*), 6) AS efficiency FROM e GROUP BY 1"""),
    "batch_quality_risk": (batch_quality_risk, f"""WITH {_BATCHES}, r AS (SELECT batch, (CASE WHEN age_days > 60 THEN 0.3 WHEN age_days > 30 THEN 0.15 WHEN age_days > 14 THEN 0.05 ELSE 0 END + CASE WHEN failed THEN 0.4 ELSE 0 END + CASE WHEN product LIKE '%fresh%' OR product LIKE '%perishable%' THEN 0.15 ELSE 0 END)::DOUBLE AS risk FROM b)
        SELECT batch, risk, CASE WHEN risk > 0.7 THEN 'Critical Quality Failure' WHEN risk > 0.5 THEN 'Quality Degradation' ELSE 'Minor Quality Issues' END AS issue, CASE WHEN risk > 0.7 THEN 'High' WHEN risk > 0.4 THEN 'Medium' ELSE 'Low' END AS severity,
        1 + (risk > 0.5)::INTEGER + (risk > 0.7)::INTEGER AS measures FROM r WHERE risk > 0.3"""),
    "supplier_quality_risk": (supplier_quality_risk, """WITH l AS (SELECT l_suppkey, round(count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*), 9) AS rate FROM lineitem GROUP BY 1),
        s AS (SELECT s_suppkey, s_acctbal, (['Farmer', 'Manufacturer', 'LogisticsProvider'])[s_suppkey % 3 + 1] AS kind, (['Local farm', 'Houston, US', 'Lyon', NULL])[s_nationkey % 4 + 1] AS place, rate FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey),
        r AS (SELECT s_suppkey, kind, (CASE WHEN s_acctbal > 5000 THEN 0 ELSE 0.3 END + CASE kind WHEN 'Manufacturer' THEN 0.05 ELSE 0.15 END + CASE WHEN lower(place) LIKE '%local%' OR lower(place) LIKE '%us%' THEN 0 ELSE 0.15 END + CASE WHEN rate < 0.9 THEN 0.2 WHEN rate < 0.95 THEN 0.1 ELSE 0 END)::DOUBLE AS risk FROM s WHERE kind <> 'LogisticsProvider')
        SELECT * FROM r WHERE risk > 0.4"""),
    "overall_risk": (overall_risk, """WITH s AS (SELECT s_suppkey, s_acctbal, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey), a AS (SELECT region, avg((s_acctbal < 0)::INTEGER) AS x FROM s GROUP BY 1),
          q AS (SELECT region, avg((l_discount > 0.08::DOUBLE)::INTEGER) AS x FROM lineitem JOIN s ON l_suppkey = s_suppkey GROUP BY 1), c AS (SELECT n_regionkey AS region, avg((o_orderstatus = 'P')::INTEGER) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
          r AS (SELECT r_regionkey AS region, round(coalesce(a.x, 0.2) * 0.4 + coalesce(q.x, 0.15) * 0.3 + coalesce(c.x, 0.1) * 0.3, 9) AS risk FROM region LEFT JOIN a ON a.region = r_regionkey LEFT JOIN q ON q.region = r_regionkey LEFT JOIN c ON c.region = r_regionkey)
        SELECT region, risk, CASE WHEN risk < 0.25 THEN 'Low' WHEN risk < 0.5 THEN 'Medium' WHEN risk < 0.75 THEN 'High' ELSE 'Critical' END AS level FROM r"""),
    "type_distribution": (type_distribution, f"""WITH t AS (SELECT p_name || ' ' || (['production run', 'PROCESSING', 'transport', 'quality check', 'transfer', 'environmental', 'compliance', 'vote'])[p_partkey % 8 + 1] AS text FROM part WHERE p_size <> 50 OR p_partkey % 8 <> 4),
        n AS (SELECT {_WORDED} AS kind, count(*) AS n FROM t GROUP BY 1)
        SELECT k.kind, coalesce(n.n, 0) AS n FROM (SELECT unnest({R.KINDS}) AS kind) k LEFT JOIN n ON k.kind = n.kind"""),
    "predicate_types": (predicate_types, f"WITH t AS (SELECT {_sql(PREDICATES, '(l_orderkey + l_linenumber) % 9')} AS p FROM lineitem) SELECT p, {_PREDICATE} AS kind, count(*) AS n FROM t GROUP BY 1, 2"),
    "policy_check": (policy_check, """WITH o AS (SELECT (['public', ' Restricted ', 'private', 'secret'])[o_orderkey % 4 + 1] AS visibility, CASE WHEN o_orderkey % 7 = 0 THEN 'AuditorMSP' ELSE 'Org' || c_nationkey % 3 END AS actor, 'Org' || o_custkey % 3 AS owner FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT visibility, CASE lower(trim(visibility)) WHEN 'public' THEN true WHEN 'restricted' THEN actor = owner OR actor = 'AuditorMSP' WHEN 'private' THEN actor = owner END AS allowed, count(*) AS n FROM o GROUP BY 1, 2"""),
    "data_operations": (data_operations, """WITH e AS (SELECT (['Personal', 'Confidential', 'Restricted', 'Internal', 'Public'])[user_id % 5 + 1] AS kind, (['read', 'write', 'delete', 'export', 'transform'])[event_id % 5 + 1] AS operation FROM events)
        SELECT operation, kind, CASE WHEN kind = 'Personal' THEN operation <> 'transform' WHEN kind IN ('Confidential', 'Restricted') THEN operation NOT IN ('export', 'transform') ELSE true END AS allowed, count(*) AS n FROM e GROUP BY 1, 2, 3"""),
    "storage_tiers": (storage_tiers, """WITH l AS (SELECT user_id, (['Hot', 'Warm', 'Cold', 'Archive'])[user_id % 4 + 1] AS tier, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') + user_id % 100 AS days FROM events GROUP BY 1),
        t AS (SELECT *, CASE WHEN tier = 'Hot' AND days > 7 THEN 'Warm' WHEN tier = 'Warm' AND days > 30 THEN 'Cold' WHEN tier = 'Cold' AND days > 90 THEN 'Archive' END AS "to" FROM l) SELECT user_id, tier, days, "to" FROM t WHERE "to" IS NOT NULL"""),
    "baseline_comparison": (baseline_comparison, """WITH e AS (SELECT event_type || CASE WHEN length(event_type) % 2 = 0 THEN '_latency' ELSE '_rate' END AS metric, event_id % 2 = 1 AS late, round(CASE WHEN event_id % 2 = 1 THEN value * (CASE WHEN length(event_type) % 2 = 0 THEN 1.6 ELSE 0.75 END)::DOUBLE ELSE value END, 4) AS v FROM events),
        m AS (SELECT metric, round(CAST(sum(CAST(v AS DECIMAL(18,4))) FILTER (NOT late) AS DOUBLE) / count(*) FILTER (NOT late), 6) AS baseline, round(CAST(sum(CAST(v AS DECIMAL(18,4))) FILTER (late) AS DOUBLE) / count(*) FILTER (late), 6) AS current FROM e GROUP BY 1),
        c AS (SELECT *, round(CASE WHEN metric LIKE '%latency' THEN current - baseline ELSE baseline - current END / baseline * 100, 4) AS change FROM m)
        SELECT *, CASE WHEN change >= 50 THEN 'critical' WHEN change >= 30 THEN 'high' WHEN change >= 20 THEN 'medium' ELSE 'low' END AS severity FROM c WHERE change > 15"""),
    "milk_and_security": (milk_and_security, """WITH t AS (SELECT lower(concat_ws(' ', p_name, (['skimmed', 'semi', 'ORGANIC', NULL])[p_partkey % 4 + 1])) AS n, p_partkey % 3 = 0 AS short FROM part)
        SELECT CASE WHEN contains(n, 'skim') THEN 'Skimmed' WHEN contains(n, 'semi') THEN 'Semi-Skimmed' WHEN contains(n, 'organic') THEN 'Organic' ELSE 'Whole' END AS milk, CASE WHEN short THEN 'High' ELSE 'Standard' END AS security, count(*) AS n FROM t GROUP BY 1, 2"""),
    "comparison_status": (comparison_status, """WITH e AS (SELECT user_id, event_type, bool_or(value > 150) AS ok FROM events GROUP BY 1, 2), s AS (SELECT user_id, count(*) AS systems, count(*) FILTER (ok) AS good FROM e GROUP BY 1)
        SELECT user_id, systems, CASE WHEN systems = 1 THEN 'single-system-contract' WHEN good = systems THEN 'valid-comparison' WHEN good > 0 THEN 'partial-comparison' ELSE 'invalid-comparison' END AS status FROM s"""),
    "demand_forecast": (demand_forecast, """WITH b AS (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT l_shipdate) AS base FROM lineitem),
        d AS (SELECT id AS day, base * (1 + 0.02::DOUBLE * id) * (1 + 0.2::DOUBLE * sin(2 * pi() * ((id + 1) / 365.0::DOUBLE))) * (1 + 0.1::DOUBLE * sin(id * 0.5::DOUBLE)) AS demand FROM range(30) r(id), b)
        SELECT day, round(demand, 4) AS demand, round(demand * 0.85::DOUBLE, 4) AS low, round(demand * 1.15::DOUBLE, 4) AS high FROM d"""),
    "forecast_accuracy": (forecast_accuracy, """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), g AS (SELECT event_type, stddev_pop(n) / avg(n) AS cv, count(*) AS points FROM d GROUP BY 1)
        SELECT event_type, round(CASE WHEN points < 10 THEN 0.75::DOUBLE ELSE greatest(0.25::DOUBLE, least(0.98::DOUBLE, CASE WHEN cv < 0.1 THEN 0.95::DOUBLE WHEN cv < 0.3 THEN 0.85::DOUBLE - (cv - 0.1::DOUBLE) * 1.25::DOUBLE WHEN cv < 0.6 THEN 0.7::DOUBLE - (cv - 0.3::DOUBLE) * 0.67::DOUBLE ELSE 0.5::DOUBLE - (cv - 0.6::DOUBLE) * 0.25::DOUBLE END)) END, 6) AS accuracy FROM g"""),
}
