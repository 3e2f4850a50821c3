"""Measures of a directed graph given as edges src, dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.closure import reach


def centrality(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree: one grouping of both ends, no join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def closeness(edges: DataFrame) -> DataFrame:
    """node, closeness: nodes reached over the sum of their distances, for nodes that reach any."""
    far = reach(edges, edges.select(F.col("src").alias("start"))).where(F.col("start") != F.col("node"))
    return far.groupBy(F.col("start").alias("node")).agg((F.count(F.lit(1)) / F.sum("dist").cast("double")).alias("closeness"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density E / (V (V - 1))."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    v = F.col("nodes").cast("double")
    return nodes.crossJoin(count).select("nodes", "edges", F.when(v > 1, F.col("edges") / (v * (v - 1))).otherwise(0.0).alias("density"))  # a row each


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that nodes does not know, as nodes of unknown type."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti").select("node", F.lit("Unknown").alias("entity_type"), F.lit(0.5).alias("confidence"))
