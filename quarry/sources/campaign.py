"""Results of benchmark campaigns: a tree of run folders in, one summary for each kind of measurement out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a summary is of.
KEYS = ["family", "scenario", "test_name", "system", "fairness_label", "capability_path", "metric_type", "unit"]
#: Fields of the metadata that are told where all rows agree in them.
AGREED = ["native_semantic_support", "external_semantic_stages", "explanation_support"]


def read_campaign(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all runs' result files, with run and epoch from the names of their folders; all other columns as texts.

    Files are found by a pattern of paths and split like any others.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{root}/epochs/epoch-*/runs/*/benchmark_results.csv")
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, r"/runs/([^/]+)/[^/]*$", 1).alias("run"), F.regexp_extract(path, r"/epochs/([^/]+)/", 1).alias("epoch"))


def agreed(col: Column) -> Column:
    """An aggregate: the one value that all rows with any have, `mixed` where they differ, empty where none has one."""
    filled = F.nullif(col, F.lit(""))
    return F.when(F.min(filled) == F.max(filled), F.min(filled)).otherwise(F.when(F.min(filled).isNull(), "").otherwise("mixed"))


def summarized(rows: DataFrame) -> DataFrame:
    """One row for each combination of KEYS: agreed metadata, runs, samples, successes, and durations and rates of the successes.

    rows: KEYS, success, duration_ms, operations_per_second, metadata_json, run,
    epoch as texts. A duration or rate that is no number is left out, an empty
    one counts as 0. The p-th percentile is the value at place p (n - 1), rounded
    half to even, from 0. Values are ranked within their group by a sort; all
    else is summed where the rows lie.
    """
    number = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("double")
    good = F.lower("success") == "true"
    rows = rows.fillna("", KEYS).withColumns({"good": F.coalesce(good, F.lit(False)), "ms": F.when(good, number("duration_ms")), "ops": F.when(good, number("operations_per_second"))})
    n, hits = F.count(F.lit(1)), F.count(F.when(F.col("good"), 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = rows.groupBy(*KEYS).agg(*[agreed(F.get_json_object("metadata_json", f"$.{k}")).alias(k) for k in AGREED], F.countDistinct("epoch").alias("epochs_observed"), F.countDistinct("run").alias("runs_observed"), n.alias("samples"), hits.alias("success_count"), (n - hits).alias("failed_count"), (hits / n * 100).alias("success_rate"), zero(F.avg("ms")).alias("mean_ms"), zero(F.stddev_pop("ms")).alias("stddev_ms"), zero(F.avg("ops")).alias("mean_ops_per_sec"))
    key = W.partitionBy(*KEYS)
    ranked = rows.where("ms is not null").withColumns({"rank": F.row_number().over(key.orderBy("ms")) - 1, "of": F.count(F.lit(1)).over(key)})
    at = lambda place: F.max(F.when(F.col("rank") == place, F.col("ms")))
    nearest = lambda f: at(F.bround((F.col("of") - 1) * f))
    middle = (at(F.floor((F.col("of") - 1) / 2)) + at(F.floor(F.col("of") / 2))) / 2
    places = ranked.groupBy(*KEYS).agg(middle.alias("median_ms"), nearest(0.95).alias("p95_ms"), nearest(0.99).alias("p99_ms"))
    return whole.join(places, KEYS, "left").fillna(0.0, ["median_ms", "p95_ms", "p99_ms"])


def metric_fields(name: Column) -> dict[str, Column]:
    """package, category, workload and scale of a metric, from its name."""
    starts, has = name.startswith, name.contains
    # Parts of names and what they stand for; the first that fits counts.
    package = F.when(starts("uht_product"), "uht").when(starts("uht_epcis"), "uht_epcis").when(starts("healthcare_device"), "healthcare_device").when(starts("pharma_storage"), "pharma_storage").otherwise("cross_package")
    category = F.when(starts("cross_package"), "cross_package").when(has("_event_setup_only"), "setup_only").when(has("_event_add_block_only"), "single_record_admission").when(has("_event_add_block"), "end_to_end").when(has("_batch_x"), "batch_scaling").when(has("_batch_add_block_only"), "batch_admission").otherwise("other")
    workload = F.when(starts("cross_package_round_robin_single_record"), "round_robin_single_record").when(starts("cross_package_round_robin_batch"), "round_robin_batch").when(has("_batch_"), "batch").when(has("_event_"), "single_record").otherwise("other")
    scale = F.when(has("_batch_x2_"), "x2").when(has("_batch_x4_"), "x4").otherwise("x1")
    return {"package": package, "category": category, "workload": workload, "scale": scale}
