"""Ledger checks over the tables taken as quads and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.ledger import gaps, graph_hash, merkle_root, quad_hash
from quarry.plans.tables import table


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and region of each nation, in a graph for each region."""
    n = table(spark, sf_dir, "nation")
    base = [F.concat(F.lit("urn:region:"), "n_regionkey").alias("g"), F.concat(F.lit("urn:nation:"), "n_nationkey").alias("s"), F.lit("iri").alias("s_kind")]
    name = n.select(*base, F.lit("urn:name").alias("p"), F.col("n_name").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    key = n.select(*base, F.lit("urn:key").alias("p"), F.col("n_nationkey").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return name.unionByName(key)


def quad_state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_quads(spark, sf_dir).select("s", "p", quad_hash().alias("hash"))


def canonical_graph_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_hash(nation_quads(spark, sf_dir))


def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_root(table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("hash")))


def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of missing order keys once every seventh pair is taken out."""
    return gaps(table(spark, sf_dir, "orders").where("o_orderkey % 14 not in (3, 4)"), "o_orderkey")


def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of a type counts as the vote for it; yes is a value of 10 and above."""
    last = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"))
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("voters"), F.count(F.when(F.col("value") >= 10, 1)).alias("yes"), (F.count(F.when(F.col("value") >= 10, 1)) * 2 > F.count(F.lit(1))).alias("passed"))


_T = """CASE WHEN p = 'urn:key' THEN '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#integer>' ELSE '"' || o || '"' END"""
_Q = """q AS (SELECT 'urn:region:' || n_regionkey AS g, 'urn:nation:' || n_nationkey AS s, 'urn:name' AS p, n_name AS o FROM nation
        UNION ALL SELECT 'urn:region:' || n_regionkey, 'urn:nation:' || n_nationkey, 'urn:key', CAST(n_nationkey AS VARCHAR) FROM nation)"""
_LEVELS = ", ".join(f"""m{k} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(max(h) FILTER (i % 2 = 0) || max(h) FILTER (i % 2 = 1)) END AS h FROM m{k - 1} GROUP BY i // 2)""" for k in range(1, 6))

QUERIES = {
    "quad_state_hash": (quad_state_hash, f"WITH {_Q} SELECT s, p, sha256('<' || g || '>' || chr(10) || '<' || s || '>' || chr(10) || '<' || p || '>' || chr(10) || {_T}) AS hash FROM q"),
    "canonical_graph_hash": (canonical_graph_hash, f"WITH {_Q}, h AS (SELECT DISTINCT g, sha256('<' || s || '>' || '<' || p || '>' || {_T}) AS h FROM q) SELECT g, sha256(string_agg(h, '' ORDER BY h)) AS hash FROM h GROUP BY g"),
    "merkle_root": (merkle, f"WITH m0 AS (SELECT row_number() OVER (ORDER BY sha256(n_name)) - 1 AS i, sha256(n_name) AS h FROM nation), {_LEVELS} SELECT h AS root FROM m5"),
    "gap_detection": (gap_detection, """WITH i AS (SELECT o_orderkey AS i, lag(o_orderkey, 1, -1) OVER (ORDER BY o_orderkey) AS prev FROM orders WHERE o_orderkey % 14 NOT IN (3, 4))
        SELECT prev + 1 AS low, i - 1 AS high FROM i WHERE i > prev + 1"""),
    "vote_tally": (vote_tally, """WITH l AS (SELECT event_type, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
        SELECT event_type, count(*) AS voters, count(*) FILTER (value >= 10) AS yes, count(*) FILTER (value >= 10) * 2 > count(*) AS passed FROM l GROUP BY 1"""),
}
