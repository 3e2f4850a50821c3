"""Aggregates over producers, entities and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.numbers import money
from quarry.plans.tables import table


def agg_by_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total quantity that each producer's transactions carry: summed by key before the join, so names travel once."""
    tx = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(money("l_quantity")).alias("total"))
    return table(spark, sf_dir, "supplier").join(tx, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", F.col("total").cast("double").alias("total_quantity"))


def producer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("total"), F.round(F.sum(price).cast("double") / F.count(F.lit(1)), 4).alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = money("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("producers"), F.round(F.sum(q).cast("double") / F.count(F.lit(1)), 6).alias("mean_quantity"), F.max("l_quantity").alias("max_quantity"))


def having_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with more than six lines: a cardinality above its maximum."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")).where("n_lines > 6")


def collect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each nation's customers."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and volume of events by day."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("volume"))


def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the daily count from the first half of the days to the second, in percent.

    Days are first counted, so that the window sees one row a day.
    """
    days = daily_history(spark, sf_dir)
    ranked = days.select("n", (F.row_number().over(W.orderBy("day")) <= F.floor(F.count(F.lit(1)).over(W.partitionBy()) / 2)).alias("early"))
    halves = ranked.agg(F.sum(F.when(F.col("early"), F.col("n"))).alias("a"), F.sum(F.when(~F.col("early"), F.col("n"))).alias("b"), F.count(F.lit(1)).alias("days"))
    rate = F.when(F.col("days") < 2, 0.0).when(F.coalesce("a", F.lit(0)) == 0, 100.0).otherwise(F.round((F.col("b") - F.col("a")) * 100.0 / F.col("a"), 6))
    return halves.select(F.col("days"), rate.alias("growth"))


def recent_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between the last ten events, and events a second."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(10)
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return last.agg(F.count(F.lit(1)).alias("n"), F.round(span, 3).alias("seconds"), F.round(F.count(F.lit(1)) / span, 6).alias("rate"))


def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and tails of event values by type, between neighbours in proportion; population deviation."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.percentile(v, F.lit(0.99)), 6).alias("p99"), F.round(F.stddev_pop(v), 4).alias("deviation"))


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place round((n - 1) 0.95) of each type's values in order.

    Ranked in a window by type; n comes by a join of counts, not by a list.
    """
    events = table(spark, sf_dir, "events").where("value is not null")
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = events.withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy("value", "event_id")) - 1)
    return ranked.join(counts, "event_type").where(F.col("r") == F.round((F.col("n") - 1) * F.lit(0.95)).cast("long")).select("event_type", "n", F.col("value").alias("p95"))


def campaign_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by priority and status: count, successes, spread of their totals, one status or several."""
    o = table(spark, sf_dir, "orders")
    x = F.col("o_totalprice")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1)), 4).alias("mean"), F.round(F.percentile(x, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(x, F.lit(0.95)), 4).alias("p95"), F.countDistinct("o_custkey").alias("customers"), F.when(F.countDistinct("o_orderstatus") == 1, F.min("o_orderstatus")).otherwise("mixed").alias("status"))


QUERIES = {
    "agg_by_producer": (agg_by_producer, """SELECT s_suppkey, s_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_quantity
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name"""),
    "producer_profile": (producer_profile, """SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
        round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high
        FROM lineitem GROUP BY l_suppkey"""),
    "global_stats": (global_stats, """SELECT count(*) AS n, count(DISTINCT l_suppkey) AS producers,
        round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean_quantity, max(l_quantity) AS max_quantity FROM lineitem"""),
    "cardinality_check": (having_lines, "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6"),
    "collect_distinct": (collect_distinct, """SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey"""),
    "daily_history": (daily_history, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS volume FROM events GROUP BY 1"),
    "growth_rate": (growth_rate, """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1),
        r AS (SELECT n, row_number() OVER (ORDER BY day) <= floor(count(*) OVER () / 2) AS early FROM d),
        h AS (SELECT sum(n) FILTER (early) AS a, sum(n) FILTER (NOT early) AS b, count(*) AS days FROM r)
        SELECT days, CASE WHEN days < 2 THEN 0.0::DOUBLE WHEN coalesce(a, 0) = 0 THEN 100.0::DOUBLE ELSE round(CAST(b - a AS DOUBLE) * 100.0::DOUBLE / CAST(a AS DOUBLE), 6) END AS growth FROM h"""),
    "recent_block_rate": (recent_rate, """WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 10), s AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS span FROM l)
        SELECT n, round(span, 3) AS seconds, round(n / span, 6) AS rate FROM s"""),
    "percentiles_linear": (percentiles_linear, """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
        round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY event_type"""),
    "percentile_nearest": (percentile_nearest, """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n
          FROM events WHERE value IS NOT NULL) SELECT event_type, n, value AS p95 FROM r WHERE r = CAST(round((n - 1) * 0.95::DOUBLE) AS BIGINT)"""),
    "campaign_rollup": (campaign_rollup, """SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success_rate,
        round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
        round(quantile_cont(o_totalprice, 0.95), 4) AS p95, count(DISTINCT o_custkey) AS customers,
        CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'mixed' END AS status FROM orders GROUP BY o_orderpriority"""),
}
