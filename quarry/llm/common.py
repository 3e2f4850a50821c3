"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of Python, Spark and SQL whitespace that end a word: blank and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode (tests) may it be unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints/quarry"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@cache
def _session_dir(spark: SparkSession, application: str) -> str:
    """A folder for this application's tables; what is left in it goes when the driver ends."""
    path = f"{shared_dir(spark)}/quarry-{application}"

    def leave() -> None:
        with contextlib.suppress(Exception):  # the context may have been stopped before
            _delete(spark, path)

    atexit.register(leave)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors.

    Tables that the caller's result still reads stay until the driver ends.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark, spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what written() wrote; only after the last use of it."""
    _delete(df.sparkSession, df.quarry_path)


def with_row_keys(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """docs with a long column key that tells rows apart and goes up with the id: the id itself where none repeats.

    Where ids repeat, each row gets a number of its own by a range partitioning
    of a written table; rows of one id come in the order of their columns that
    can be ordered, so that equal tables get equal results. A null id comes first.
    """
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    order = [id_col, *[c for c, kind in docs.dtypes if c != id_col and "map" not in kind and "variant" not in kind]]
    return written(docs.repartitionByRange(id_col).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def literal_longs(numbers: list[int]) -> Column:
    """An array<bigint> of the plan's own: one folded literal, where lit() would make a node of each number."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (long). Nulls and self-links are ignored, repeats and
    both directions are welcome. Returns node, component (the smallest node
    reachable) for every node with a link to another. Each step groups with
    partial aggregation and joins the minimum back, so that AQE can split the
    rows of a hub; each round ends in a written table.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).alias("m")
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = now.agg(mark).first()["m"]
    for _ in range(rounds):
        if not before["n"]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: the larger neighbours of a node link to its smallest
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, link to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct()
        after = written(small)
        mark_after = after.agg(mark).first()["m"]
        discard(now)
        now = after
        if mark_after == before:
            break
        before = mark_after
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def settle(spark: SparkSession) -> None:
    """Let the driver's collectors run, so that shuffle files behind tables that are already written can go."""
    gc.collect()
    spark._jvm.System.gc()
