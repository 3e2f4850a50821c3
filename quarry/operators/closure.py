"""Reachability and paths over an edge table (src, dst), one join for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.stage import stored


def reach(edges: DataFrame, starts: DataFrame, steps: int | None = None) -> DataFrame:
    """start, node, dist: the nodes that each start reaches over 1 to steps edges, with the fewest.

    starts: one column, start. Only pairs that are new in a step go on to the
    next, so cycles end and each pair is joined once; the loop ends with the step
    that finds nothing. A start that lies on a cycle reaches itself. Edges are
    computed once, not in each round.
    """
    edges = stored(edges.select("src", "dst").distinct())
    front = stored(starts.select("start").distinct().join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().withColumn("dist", F.lit(1)))
    found, step = front, 1
    while (steps is None or step < steps) and not front.isEmpty():
        step += 1
        new = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = stored(new.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("dist", F.lit(step)))
        found = found.unionByName(front)
    return found


def bounded_paths(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """start, nodes array, steps: all simple paths of 1 to steps edges from the starts."""
    edges = edges.select("src", "dst").distinct()
    front = starts.select("start", F.col("start").alias("at"), F.array("start").alias("nodes"))
    found = None
    for step in range(1, steps + 1):
        front = front.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"))
        rows = front.select("start", "nodes", F.lit(step).alias("steps"))
        found = rows if found is None else found.unionByName(rows)
    return found


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node joined to it over edges in either direction.

    Each round a node takes the smallest label of its neighbours, and then the
    label of that label, so long chains shorten by halves.
    """
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        closer = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("label", "near").alias("label"))
        jump = closer.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = stored(closer.join(jump, "label").select("node", F.least("label", "above").alias("label")))
        same = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty()
        labels = after
        if same:
            return labels.withColumnRenamed("label", "component")


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row, has_cycle: whether anything is left when nodes without a way in are taken away again and again."""
    left = stored(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = stored(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return left.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_cycle"))
