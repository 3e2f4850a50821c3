"""Required properties, conclusions, cardinalities, class hierarchies, and summaries of measurements, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rules as R
from quarry.plans.quads import _CHAIN, chain
from quarry.plans.tables import table
from quarry.sources.campaign import KEYS, metric_fields, summarized

_KINDS = [("supply_chain", "ProductBatch", "hasBatchID", "originFarm"), ("supply_chain", "QualityCheck", "qualityCheckDate", None), ("healthcare", "MedicalDevice", "medicalDeviceSerial", None), ("pharmaceutical", "DrugBatch", "hasDrugID", "hasBatchNumber"), ("pharmaceutical", "Unheard", "nothing", None)]


def adapter_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of three domains: the property that each lacks, what is wrong with a value, what follows from the others."""
    p = table(spark, sf_dir, "part")
    key, n = F.col("p_partkey"), len(_KINDS)
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in _KINDS]), (key % n).cast("int") + 1)
    entry = lambda name, value, where: F.when(where & name.isNotNull(), F.struct(name.alias("key"), value.alias("value")))
    entries = F.array_compact(F.array(entry(pick(2), F.col("p_name"), key % 3 != 0), entry(pick(3), F.col("p_brand"), key % 4 != 0), *[entry(F.lit(k), F.col("p_size").cast("string"), key % m == 0) for k, m in (("producedBy", 2), ("locatedAt", 7), ("inputTo", 5), ("outputOf", 3))]))
    rows = p.select("p_partkey", pick(0).alias("domain"), pick(1).alias("kind"), F.map_from_entries(entries).alias("properties"))
    checks = {"locatedAt": [("too large", lambda v: v.cast("int") > 40)], "outputOf": [("odd", lambda v: v.cast("int") % 2 == 1), ("small", lambda v: v.cast("int") < 10)]}
    return rows.select("p_partkey", R.missing_property(F.col("domain"), F.col("kind"), F.col("properties")).alias("missing"), R.first_problem(F.col("properties"), checks).alias("problem"), F.array_join(R.conclusions(F.col("properties")), " ").alias("follows"))


def known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order's graph whether it holds a product or a batch."""
    return R.with_known_types(chain(spark, sf_dir), ["urn:core#Product", "urn:core#Batch"], "urn:rdf#type")


def domain_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a hierarchy of classes with breaks: those under none of two core classes."""
    p, cls = table(spark, sf_dir, "part"), lambda k: F.concat(F.lit("urn:class/"), k.cast("string"))
    key = F.col("p_partkey")
    edges = p.where((key > 3) & (key % 11 != 0)).select(cls(key).alias("sub"), cls(F.floor(key / 2)).alias("super"))
    return R.outside_core(p.where(key > 0).select(cls(key).alias("cls")), edges, ["urn:class/2", "urn:class/3"])


def qualified_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status under restrictions on how many items of a class they have, items by flag under subclasses: what breaks them."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    order = lambda k: F.concat(F.lit("urn:order/"), k.cast("string"))
    item = F.concat(F.lit("urn:item/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), "l_returnflag")
    quad = lambda s, p, q: F.struct(s.alias("s"), F.lit(p).alias("p"), q.alias("o"))
    rows = [o.select(quad(order(F.col("o_orderkey")), R.RDF + "type", F.concat(F.lit("urn:o#"), "o_orderstatus")).alias("q")), li.select(F.explode(F.array(quad(order(F.col("l_orderkey")), "urn:has", item), quad(item, R.RDF + "type", F.concat(F.lit("urn:i#"), "l_returnflag")))).alias("q"))]
    facts = [(f"_:{s}", R.OWL + "onProperty", "urn:has") for s in "OFP"] + [(f"_:{s}", R.OWL + "onClass", "urn:i#Done") for s in "OFP"] + [(f"urn:o#{s}", R.SUBCLASS, f"_:{s}") for s in "OFP"] + [("urn:i#A", R.SUBCLASS, "urn:i#Closed"), ("urn:i#R", R.SUBCLASS, "urn:i#Closed"), ("urn:i#Closed", R.SUBCLASS, "urn:i#Done")]
    facts += [("_:O", R.OWL + "qualifiedCardinality", "2"), ("_:F", R.OWL + "minQualifiedCardinality", "2"), ("_:P", R.OWL + "maxQualifiedCardinality", "3")]
    quads = rows[0].unionByName(rows[1]).select("q.*").unionByName(spark.createDataFrame(facts, "s string, p string, o string"))
    return R.qualified_violations(quads).select("s", "class", "kind", "wanted", "found")


def campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements: one summary for each combination of eight keys."""
    li = table(spark, sf_dir, "lineitem")
    keys = dict(zip(KEYS, [F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_linenumber") % 3).cast("string"), (F.col("l_suppkey") % 2).cast("string"), F.lit("fair"), F.lit("path"), F.lit("ms"), F.lit("")]))
    meta = F.concat(F.lit('{"native_semantic_support":"'), F.when(F.col("l_linenumber") % 3 == 0, "yes").otherwise((F.col("l_suppkey") % 3).cast("string")), F.lit('"}'))
    rows = li.select(*[c.alias(k) for k, c in keys.items()], F.when(F.col("l_discount") > 0.02, "True").otherwise("false").alias("success"), F.when(F.col("l_partkey") % 50 == 0, "none").when(F.col("l_partkey") % 51 == 0, "").otherwise(F.format_string("%.2f", "l_extendedprice")).alias("duration_ms"), F.col("l_quantity").cast("string").alias("operations_per_second"), meta.alias("metadata_json"), (F.col("l_orderkey") % 7).cast("string").alias("run"), (F.col("l_orderkey") % 2).cast("string").alias("epoch"))
    s = summarized(rows)
    return s.select("family", "scenario", "test_name", "system", "native_semantic_support", "external_semantic_stages", "epochs_observed", "runs_observed", "samples", "success_count", "failed_count", *[F.round(c, 4).alias(c) for c in ("success_rate", "mean_ms", "median_ms", "p95_ms", "p99_ms", "mean_ops_per_sec")], F.round("stddev_ms", 2).alias("stddev_ms"))


def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of metrics by what their parts stand for."""
    key = F.col("p_partkey")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names)).cast("int") + 1)
    name = F.concat(pick(key, "uht_product", "uht_epcis", "healthcare_device", "pharma_storage", "cross_package_round_robin", "other"), pick(F.floor(key / 6), "_event_setup_only", "_event_add_block_only", "_event_add_block", "_batch_x2_a", "_batch_x4_b", "_batch_add_block_only", "_single_record", "_batch"))
    return table(spark, sf_dir, "part").select(*[c.alias(k) for k, c in metric_fields(name).items()]).groupBy("package", "category", "workload", "scale").agg(F.count(F.lit(1)).alias("n"))


_M = """(list_value('uht_product', 'uht_epcis', 'healthcare_device', 'pharma_storage', 'cross_package_round_robin', 'other'))[p_partkey % 6 + 1] || (list_value('_event_setup_only', '_event_add_block_only', '_event_add_block', '_batch_x2_a', '_batch_x4_b', '_batch_add_block_only', '_single_record', '_batch'))[p_partkey // 6 % 8 + 1]"""

QUERIES = {
    "adapter_problems": (adapter_problems, """WITH k AS (SELECT p_partkey AS k, p_size AS v, p_partkey % 5 AS t FROM part)
        SELECT k AS p_partkey, CASE t WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'hasBatchID' WHEN k % 4 = 0 THEN 'originFarm' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'qualityCheckDate' END WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'medicalDeviceSerial' END WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'hasDrugID' WHEN k % 4 = 0 THEN 'hasBatchNumber' END END AS missing,
        CASE WHEN k % 7 = 0 AND v > 40 THEN 'locatedAt: too large' WHEN k % 3 = 0 AND v % 2 = 1 THEN 'outputOf: odd' WHEN k % 3 = 0 AND v < 10 THEN 'outputOf: small' END AS problem, concat_ws(' ', CASE WHEN k % 14 = 0 THEN 'InferredLocation' END, CASE WHEN k % 15 = 0 THEN 'InferredProcessChain' END) AS follows FROM k"""),
    "known_types": (known_types, f"WITH {_CHAIN} SELECT g, bool_or(p = 'urn:rdf#type' AND o IN ('urn:core#Product', 'urn:core#Batch')) AS known FROM q GROUP BY 1"),
    "domain_extension": (domain_extension, """WITH RECURSIVE e AS (SELECT p_partkey AS sub, p_partkey // 2 AS super FROM part WHERE p_partkey > 3 AND p_partkey % 11 <> 0), d AS (SELECT 2 AS c UNION SELECT 3 UNION SELECT e.sub FROM d JOIN e ON e.super = d.c)
        SELECT DISTINCT 'urn:class/' || p_partkey AS cls FROM part WHERE p_partkey > 0 AND p_partkey NOT IN (SELECT c FROM d)"""),
    "qualified_cardinality": (qualified_cardinality, """WITH n AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber || l_returnflag) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), o AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS st FROM orders), c AS (SELECT o.k, st, coalesce(n, 0) AS found FROM o LEFT JOIN n ON n.k = o.k)
        SELECT 'urn:order/' || k AS s, 'urn:o#' || st AS class, CASE st WHEN 'O' THEN 'exactly' WHEN 'F' THEN 'min' ELSE 'max' END AS kind, CASE st WHEN 'P' THEN 3 ELSE 2 END::BIGINT AS wanted, found FROM c WHERE (st = 'O' AND found <> 2) OR (st = 'F' AND found < 2) OR (st = 'P' AND found > 3)"""),
    "campaign_summary": (campaign_summary, """WITH r AS (SELECT l_returnflag AS family, l_linestatus AS scenario, (l_linenumber % 3)::VARCHAR AS test_name, (l_suppkey % 2)::VARCHAR AS system, l_linenumber % 3 = 0 AS sure, l_suppkey % 3 AS m, l_orderkey % 7 AS run, l_orderkey % 2 AS epoch, l_discount > 0.02::DOUBLE AS good,
            CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 51 = 0 THEN 0.0::DOUBLE ELSE round(l_extendedprice, 2) END AS ms, l_quantity AS ops FROM lineitem),
          w AS (SELECT family, scenario, test_name, system, list_sort(list(ms) FILTER (good AND ms IS NOT NULL)) AS v, CASE WHEN bool_and(sure) THEN 'yes' WHEN min(m) = max(m) THEN min(m)::VARCHAR ELSE 'mixed' END AS native_semantic_support, count(DISTINCT epoch) AS epochs_observed, count(DISTINCT run) AS runs_observed, count(*) AS samples,
            count(*) FILTER (good) AS success_count, avg(ms) FILTER (good) AS a, stddev_pop(ms) FILTER (good) AS d, avg(ops) FILTER (good) AS o FROM r GROUP BY 1, 2, 3, 4)
        SELECT family, scenario, test_name, system, native_semantic_support, '' AS external_semantic_stages, epochs_observed, runs_observed, samples, success_count, samples - success_count AS failed_count, round(success_count / samples * 100, 4) AS success_rate, round(coalesce(a, 0), 4) AS mean_ms,
          round(coalesce((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 0), 4) AS median_ms, round(coalesce(v[round_even((len(v) - 1) * 0.95::DOUBLE, 0)::INTEGER + 1], 0), 4) AS p95_ms, round(coalesce(v[round_even((len(v) - 1) * 0.99::DOUBLE, 0)::INTEGER + 1], 0), 4) AS p99_ms, round(coalesce(o, 0), 4) AS mean_ops_per_sec, round(coalesce(d, 0), 2) AS stddev_ms FROM w"""),
    "metric_names": (metric_names, f"""WITH m AS (SELECT {_M} AS n FROM part) SELECT CASE WHEN n LIKE 'uht!_product%' ESCAPE '!' THEN 'uht' WHEN n LIKE 'uht!_epcis%' ESCAPE '!' THEN 'uht_epcis' WHEN n LIKE 'healthcare%' THEN 'healthcare_device' WHEN n LIKE 'pharma%' THEN 'pharma_storage' ELSE 'cross_package' END AS package,
        CASE WHEN n LIKE 'cross%' THEN 'cross_package' WHEN contains(n, '_event_setup_only') THEN 'setup_only' WHEN contains(n, '_event_add_block_only') THEN 'single_record_admission' WHEN contains(n, '_event_add_block') THEN 'end_to_end' WHEN contains(n, '_batch_x') THEN 'batch_scaling' WHEN contains(n, '_batch_add_block_only') THEN 'batch_admission' ELSE 'other' END AS category,
        CASE WHEN starts_with(n, 'cross_package_round_robin_single_record') THEN 'round_robin_single_record' WHEN starts_with(n, 'cross_package_round_robin_batch') THEN 'round_robin_batch' WHEN contains(n, '_batch_') THEN 'batch' WHEN contains(n, '_event_') THEN 'single_record' ELSE 'other' END AS workload,
        CASE WHEN contains(n, '_batch_x2_') THEN 'x2' WHEN contains(n, '_batch_x4_') THEN 'x4' ELSE 'x1' END AS scale, count(*) AS n FROM m GROUP BY 1, 2, 3, 4"""),
}
