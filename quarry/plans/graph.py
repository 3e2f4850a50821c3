"""Graph measures over the geography and order graphs of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.closure import has_cycle, reach, weak_components
from quarry.operators.graph import centrality, closeness, graph_stats, implicit_nodes
from quarry.plans.tables import table


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from regions to their nations, and from nations to their suppliers."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return n.unionByName(s)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to their orders."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))


def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = geography(spark, sf_dir)
    return reach(e, e.where("src like 'r%'").select(F.col("src").alias("start")), 2).select("start", "node", "dist")


def shortest_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest edges from region 1 to each supplier that it reaches."""
    e = geography(spark, sf_dir)
    return reach(e, spark.createDataFrame([("r1",)], "start string")).where("node like 's%'").select("node", "dist")


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality(geography(spark, sf_dir))


def closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closeness(geography(spark, sf_dir)).select("node", F.round("closeness", 9).alias("closeness"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_stats(trade(spark, sf_dir)).select("nodes", "edges", F.round("density", 12).alias("density"))


def communities_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with all their orders, by connected components."""
    return weak_components(table(spark, sf_dir, "orders").select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"))).groupBy((-F.col("component") - 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_cycle(geography(spark, sf_dir))


def entity_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from or to nation 3: a union of two equality filters, not an OR."""
    e = geography(spark, sf_dir)
    return e.where("src = 'n3'").unionByName(e.where("dst = 'n3' and src <> 'n3'"))


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only edges name: nations are known, regions and suppliers are not."""
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return implicit_nodes(geography(spark, sf_dir), known)


_GEO = """geo AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""
_REACH = """reach AS (SELECT src AS start, dst AS node, 1 AS dist FROM geo UNION SELECT r.start, g.dst, r.dist + 1 FROM reach r JOIN geo g ON r.node = g.src)"""

QUERIES = {
    "khop_neighbors": (khop_neighbors, f"WITH RECURSIVE {_GEO}, {_REACH} SELECT start, node, min(dist) AS dist FROM reach WHERE start LIKE 'r%' AND dist <= 2 GROUP BY 1, 2"),
    "shortest_length": (shortest_length, f"WITH RECURSIVE {_GEO}, {_REACH} SELECT node, min(dist) AS dist FROM reach WHERE start = 'r1' AND node LIKE 's%' GROUP BY 1"),
    "degree_centrality": (degree_centrality, f"""WITH {_GEO}, o AS (SELECT src AS node, count(*) AS n FROM geo GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM geo GROUP BY 1)
        SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i ON o.node = i.node"""),
    "closeness": (closeness_centrality, f"""WITH RECURSIVE {_GEO}, {_REACH}, m AS (SELECT start, node, min(dist) AS dist FROM reach GROUP BY 1, 2)
        SELECT start AS node, round(count(*) / CAST(sum(dist) AS DOUBLE), 9) AS closeness FROM m GROUP BY 1"""),
    "graph_stats": (stats, """WITH t AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders), v AS (SELECT src FROM t UNION SELECT dst FROM t)
        SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM t) AS edges,
        round((SELECT count(*) FROM t)::DOUBLE / ((SELECT count(*) FROM v)::DOUBLE * ((SELECT count(*) FROM v) - 1)), 12) AS density"""),
    "cycle_check": (cycle_check, f"WITH RECURSIVE {_GEO}, {_REACH} SELECT EXISTS (SELECT 1 FROM reach WHERE start = node) AS has_cycle"),
    "entity_relationships": (entity_relationships, f"WITH {_GEO} SELECT src, dst FROM geo WHERE src = 'n3' OR dst = 'n3'"),
    "implicit_nodes": (dangling, f"WITH {_GEO} SELECT node, 'Unknown' AS entity_type, 0.5::DOUBLE AS confidence FROM (SELECT src AS node FROM geo UNION SELECT dst FROM geo) WHERE node NOT IN (SELECT 'n' || n_nationkey FROM nation)"),
    "communities_wcc": (communities_wcc, "SELECT o_custkey AS component, count(*) + 1 AS n FROM orders GROUP BY 1"),
}
