"""Canonical hashes, Merkle roots and checks of a chain of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.terms import nt, nt_text
from quarry.operators.stage import stored


def quad_hash() -> Column:
    """SHA-256 of a quad's terms in N-Triples form, one a line, graph first."""
    graph = F.coalesce(F.concat(F.lit("<"), F.col("g"), F.lit(">")), F.lit("DEFAULT"))
    return F.sha2(F.concat_ws("\n", graph, nt("s", "s_kind"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), nt("o", "o_kind", "o_dt", "o_lang")), 256)


def triple_hash(of: Callable[[str], Column] = F.col) -> Column:
    """SHA-256 of a triple where blank nodes have no name, only a side; of gives its columns."""
    s = F.when(of("s_kind") == "bnode", F.lit("Magic_S")).otherwise(nt(of("s"), of("s_kind")))
    o = F.when(of("o_kind") == "bnode", F.lit("Magic_O")).otherwise(nt(of("o"), of("o_kind"), of("o_dt"), of("o_lang")))
    return F.sha2(F.concat(s, F.concat(F.lit("<"), of("p"), F.lit(">")), o), 256)


def graph_hash(quads: DataFrame, *more: Column) -> DataFrame:
    """g, hash: of the sorted different triple hashes of each named graph; more are further aggregates of its quads.

    A graph is hashed in one row, so graphs should be of block size.
    """
    return quads.where("g is not null").groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(triple_hash())), ""), 256).alias("hash"), *more)


def quads_hash(quads: str) -> Column:
    """graph_hash() of a graph whose quads are an array in its row."""
    hashes = F.array_compact(F.transform(quads, lambda q: triple_hash(q.getField)))
    return F.sha2(F.array_join(F.sort_array(F.array_distinct(hashes)), ""), 256)


def rows_hash(rows: Iterable[tuple]) -> str:
    """quads_hash() of a graph's triples (s, s_kind, p, o, o_kind, o_dt, o_lang) in a task's Python."""
    told = (("Magic_S" if of == "bnode" else nt_text(s, of)) + f"<{p}>" + ("Magic_O" if kind == "bnode" else nt_text(o, kind, dt, lang)) for s, of, p, o, kind, dt, lang in rows)
    return sha256("".join(sorted({sha256(t.encode()).hexdigest() for t in told})).encode()).hexdigest()


def merkle_root(leaves: DataFrame, col: str = "hash") -> DataFrame:
    """One row, root: pairs of sorted leaves hashed level by level, an odd one promoted; 64 zeros without leaves.

    Ranks come from a range partitioning: counts of the parts, then ranks within
    them, so that no task sorts all leaves. Each level is one grouping by half the rank.
    """
    leaves = leaves.select(F.col(col).alias("hash"))
    parts = stored(leaves.repartitionByRange("hash").sortWithinPartitions("hash").select("hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    base = parts.groupBy("part").agg(F.min("at").alias("base"), F.count(F.lit(1)).alias("n"))
    base = base.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    level = parts.join(F.broadcast(base.select("part", "base", "before")), "part").select((F.col("at") - F.col("base") + F.col("before")).alias("i"), "hash")
    n = parts.count()
    steps = 0
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i"))
        level = pair.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("hash"))).alias("r")).select("i", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
        n, steps = (n + 1) // 2, steps + 1
        if steps % 8 == 0:
            level = stored(level)
    return level.agg(F.coalesce(F.max("hash"), F.lit("0" * 64)).alias("root"))


def block_hash(index: str, timestamp: str, data: str, previous: str | Column, validator: str, encrypted: Column | None = None) -> Column:
    """SHA-256 of index, time, hash of the data, previous hash, validator and encrypted data, one after the other."""
    parts = [F.col(index).cast("string"), F.col(timestamp), F.sha2(F.col(data), 256), F.col(previous) if isinstance(previous, str) else previous, F.col(validator), F.lit("") if encrypted is None else F.coalesce(encrypted, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def gaps(indices: DataFrame, col: str) -> DataFrame:
    """low, high: ranges of indices from 0 that are missing below the largest.

    The predecessor is found within ranges of indices and, for the first of each,
    from the table of the ranges' maxima.
    """
    idx = indices.select(F.col(col).alias("i")).distinct()
    size = 1 << 20
    cut = idx.withColumn("part", F.floor(F.col("i") / size))
    edge = cut.groupBy("part").agg(F.max("i").alias("top"))
    edge = edge.select("part", F.lag("top").over(W.orderBy("part")).alias("below"))  # a row for each range
    prev = cut.join(F.broadcast(edge), "part").withColumn("prev", F.coalesce(F.lag("i").over(W.partitionBy("part").orderBy("i")), "below", F.lit(-1)))
    return prev.where("i > prev + 1").select((F.col("prev") + 1).alias("low"), (F.col("i") - 1).alias("high"))
