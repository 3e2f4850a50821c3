"""Cutting the lineage of loops."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode (tests) may it be unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints/quarry"
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@cache
def _session_dir(spark: SparkSession, application: str) -> str:
    """A folder for this application's tables; what is left in it goes when the driver ends."""
    path = f"{shared_dir(spark)}/quarry-stages-{application}"

    def leave() -> None:
        with contextlib.suppress(Exception):  # the context may have been stopped before
            delete(spark, path)

    atexit.register(leave)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the folder that driver and executors share.

    Written and read again rather than checkpointed: what the planner knows of a
    loop's rows would grow with every round otherwise.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark, spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
