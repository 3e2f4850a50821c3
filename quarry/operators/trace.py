"""Tracing products through their transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.bgp import Pattern, match, star
from quarry.operators.stage import stored


def frontier_trace(quads: DataFrame, seed: str, depth: int = 50, fraction: float = 1.0) -> DataFrame:
    """hop, s, p, o: the events that each hop from seed finds, over links in both directions.

    One join a hop, over all graphs. With a fraction below 1 a frontier of more
    than ten goes on with that share of its best connected nodes; 1 is exact.
    """
    links = quads.where("o_kind = 'iri'").select("s", "p", "o")
    degree = links.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    seen = front = stored(quads.sparkSession.createDataFrame([(seed,)], "node string"))
    found = None
    for hop in range(1, depth + 1):
        out = links.join(front, links["s"] == front["node"]).select("s", "p", "o", F.col("o").alias("to"))
        back = links.join(front, links["o"] == front["node"]).select("s", "p", "o", F.col("s").alias("to"))
        met = stored(out.unionByName(back).distinct().withColumn("hop", F.lit(hop)))
        events = met.select("hop", "s", "p", "o").distinct()
        found = events if found is None else found.unionByName(events)
        front = met.select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        if fraction < 1:
            many = front.count()
            if many > 10:
                front = front.join(degree, "node").orderBy(F.desc("degree"), "node").limit(int(many * fraction)).select("node")
        front = stored(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found.groupBy("s", "p", "o").agg(F.min("hop").alias("hop")).select("hop", "s", "p", "o")


def products(quads: DataFrame, cls: str, predicates: dict[str, str], search: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the instances of a class with their properties, by subject."""
    typed = quads.where((F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type") & (F.col("o") == cls)).select("s").distinct()
    found = typed.join(star(quads, predicates), "s", "left")
    if search:
        anywhere = F.lower(F.concat_ws(" ", "s", *predicates))
        found = found.where(anywhere.contains(search.lower()))
    size = min(max(1, size), 100)
    return found.orderBy("s").offset((max(1, page) - 1) * size).limit(size)


def steps(quads: DataFrame, link: str, when: str, more: dict[str, str]) -> DataFrame:
    """product, step, time and more: the activities of each product in order of time."""
    found = match(quads, [Pattern("?step", link, "?product")], [[Pattern("?step", when, "?time")], *[[Pattern("?step", p, f"?{name}")] for name, p in more.items()]])
    return found.withColumn("n", F.row_number().over(W.partitionBy("product").orderBy(F.col("time").asc_nulls_first(), "step")))


def related(quads: DataFrame, item: str, predicates: list[str]) -> DataFrame:
    """other, p: what shares the value of one of predicates with item."""
    mine = quads.where((F.col("s") == item) & F.col("p").isin(*predicates)).select("p", "o").distinct()
    return quads.where(F.col("s") != item).join(mine, ["p", "o"], "left_semi").select(F.col("s").alias("other"), "p").distinct()
