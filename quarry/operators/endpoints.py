"""What a user of a traceability ledger asks for: products, their ways and origins, participants, blocks; paged and in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 20) -> DataFrame:
    """A page of rows in order, with total and pages: pages from 1, of 1 to 100 rows.

    Only the rows up to the page's end are sorted (a top-k), the total is counted
    where the rows lie.
    """
    size, page = min(max(1, size), 100), max(1, page)
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # a row


def items(quads: DataFrame, predicates: dict[str, str], required: list[str] = ()) -> DataFrame:
    """g, s and a column for each predicate (name to predicate) with an array of its different values: one grouping for all optional parts.

    Those required must be there; the others are empty arrays where they are not.
    """
    found = quads.where(F.col("p").isin(*predicates.values())).groupBy("g", "s").agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(name) for name, p in predicates.items()])
    for name in required:
        found = found.where(F.size(name) > 0)
    return found


def bindings(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows of items() with a row for each combination of the values of names; null where there is none, as for an optional part."""
    for name in names:
        rows = rows.withColumn(name, F.explode_outer(name))
    return rows


def trace(rows: DataFrame, product: str, time: str) -> DataFrame:
    """rows with n: the steps of each product in order of time, those without one first, ties by subject."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(product).orderBy(F.col(time).asc_nulls_first(), "s", *[c for c in rows.columns if c not in (product, time, "s")])))


def provenance(quads: DataFrame, derived: str, generated: str, associated: str, time: str, place: str) -> DataFrame:
    """source, entity, activity, agent, time, place: what was derived from each source, how, by whom, when and where, as far as it is told.

    All parts of an entity must lie in its graph. A source from which nothing is
    derived has no rows.
    """
    entity = items(quads, {"source": derived, "activity": generated, "time": time, "place": place}, ["source"])
    rows = bindings(entity, ["source", "activity", "time", "place"])
    agents = quads.where(F.col("p") == associated).select("g", F.col("s").alias("activity"), F.col("o").alias("agent")).distinct()
    return rows.join(agents, ["g", "activity"], "left").select("source", F.col("s").alias("entity"), "activity", "agent", "time", "place")


def recent(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows in order, with their place from 1."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))  # n rows


def status(blocks: DataFrame, index: str, time: str, sample: int = 10) -> DataFrame:
    """One row: blocks, last (time), block_seconds and per_second over the last blocks, at most `sample` of them.

    Blocks in order of index. Where there are fewer than three, or the last ones
    span no time, 10 seconds and 0.1 stand in (fixed values).
    """
    whole = blocks.agg(F.count(F.lit(1)).alias("blocks"))
    take = F.least(F.col("blocks") - 1, F.lit(sample))
    last = blocks.select(F.col(index).alias("i"), F.unix_seconds(F.col(time).cast("timestamp")).alias("t"), F.col(time).alias("at")).orderBy(F.desc("i")).limit(sample)
    ranked = last.withColumn("r", F.row_number().over(W.orderBy(F.desc("i")))).crossJoin(F.broadcast(whole))  # at most `sample` rows, and one
    inside = F.col("r") <= take
    span = (F.max_by(F.when(inside, F.col("t")), F.when(inside, F.col("i"))) - F.min_by(F.when(inside, F.col("t")), F.when(inside, F.col("i")))).alias("span")
    one = ranked.groupBy("blocks").agg(F.max_by("at", "i").alias("last"), span, (F.count(F.when(inside, 1)) - 1).alias("steps"))
    timed = (F.col("blocks") > 2) & (F.col("span") > 0)
    return one.select("blocks", "last", F.when(timed, F.col("span") / F.col("steps")).otherwise(10.0).alias("block_seconds"), F.when(timed, F.col("steps") / F.col("span")).otherwise(0.1).alias("per_second"))
