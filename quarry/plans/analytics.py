"""Scores, footprints and forecasts over the tables taken as batches and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.numbers import money
from quarry.plans.tables import table

def quality_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of checks at 0.7 or above, mean and defects, by kind; an empty set passes."""
    score = 1 - F.col("l_discount") * 4
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(score >= 0.7, 1)).alias("passed"), F.sum(F.round(score, 4).cast("decimal(18,4)")).alias("total"))
    return out.select("l_returnflag", F.round(F.col("passed") / F.col("n"), 9).alias("pass_rate"), F.round(F.col("total").cast("double") / F.col("n"), 9).alias("mean_score"), F.round(1 - F.col("passed") / F.col("n"), 9).alias("defect_rate"))


def trend_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each type's last five values against the five before: more than twice is degrading, less than half improving."""
    ranked = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("event_id")))).where("r <= 10")
    v = money("value")
    g = ranked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") <= 5, v)).cast("double").alias("new"), F.sum(F.when(F.col("r") > 5, v)).cast("double").alias("old"))
    return g.select("event_type", F.when(F.col("n") < 10, "Stable").when(F.col("new") > 2 * F.col("old"), "Degrading").when(F.col("new") < F.col("old") / 2, "Improving").otherwise("Stable").alias("trend"))


def rolling_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good events among each user's last ten, as a grade."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    share = F.avg(F.when(F.col("event_type") != "error", 100.0).otherwise(0.0)).over(w)
    return table(spark, sf_dir, "events").select("event_id", share.alias("share")).select("event_id", F.when(F.col("share") >= 90, "Excellent").when(F.col("share") >= 75, "Good").when(F.col("share") >= 50, "Concerning").otherwise("Critical").alias("grade"))


def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, intercept and fit of each type's values over its days."""
    x = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    y = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 5).alias("intercept"), F.round(F.regr_r2(y, x), 5).alias("r2"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of events by type and day: days are counted before the window."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("event_type", "day", F.sum("n").over(W.partitionBy("event_type").orderBy("day")).alias("total"))


QUERIES = {
    "quality_pass_rate": (quality_pass_rate, """WITH s AS (SELECT l_returnflag, 1 - l_discount * 4 AS score FROM lineitem)
        SELECT l_returnflag, round(count(*) FILTER (score >= 0.7::DOUBLE)::DOUBLE / count(*), 9) AS pass_rate, round(CAST(sum(CAST(round(score, 4) AS DECIMAL(18,4))) AS DOUBLE) / count(*), 9) AS mean_score,
        round(1 - count(*) FILTER (score >= 0.7::DOUBLE)::DOUBLE / count(*), 9) AS defect_rate FROM s GROUP BY 1"""),
    "trend_last5": (trend_last5, """WITH r AS (SELECT event_type, CAST(value AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events QUALIFY r <= 10),
        g AS (SELECT event_type, count(*) AS n, CAST(sum(v) FILTER (r <= 5) AS DOUBLE) AS new, CAST(sum(v) FILTER (r > 5) AS DOUBLE) AS old FROM r GROUP BY 1)
        SELECT event_type, CASE WHEN n < 10 THEN 'Stable' WHEN new > 2 * old THEN 'Degrading' WHEN new < old / 2 THEN 'Improving' ELSE 'Stable' END AS trend FROM g"""),
    "rolling_health": (rolling_health, """WITH s AS (SELECT event_id, avg(CASE WHEN event_type <> 'error' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS share FROM events)
        SELECT event_id, CASE WHEN share >= 90 THEN 'Excellent' WHEN share >= 75 THEN 'Good' WHEN share >= 50 THEN 'Concerning' ELSE 'Critical' END AS grade FROM s"""),
    "linear_trend": (linear_trend, """WITH d AS (SELECT event_type, value AS y, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x FROM events)
        SELECT event_type, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 5) AS r2 FROM d GROUP BY 1"""),
    "running_snapshots": (snapshots, """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total FROM d"""),
}
