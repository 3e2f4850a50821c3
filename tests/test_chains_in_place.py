"""Chains put together where they lie: as rounds of joins do it, on odd chains, and with one shuffle of events."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from quarry.operators.chains import ZEROS, audited

ODD = {
    1: [("a", ZEROS), ("b", "a"), ("c", "b"), ("d", "b"), ("b", "a"), ("e", "d"), ("f", "c"), (None, "f"), ("z", "lost"), ("y", "z")],
    2: [("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("self", "self"), ("n", None), ("m", "n"), ("m", "x"), ("k", "p"), ("k", None)],
    3: [("a", "lost")],
    None: [("a", ZEROS), ("b", "a")],
    4: [(f"h{i:03}", f"h{i - 1:03}" if i else ZEROS) for i in range(300)],
}


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_odd_chains(spark, batch):
    rows = [(c, h, p, i, h == "c") for c, blocks in ODD.items() for i, (h, p) in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, "chain long, hash string, previous string, index long, bad boolean").coalesce(1)
    digest = F.when(F.col("bad"), "other").otherwise(F.col("hash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sorted((tuple(r) for r in audited(blocks, digest, in_place=True).select("chain", "hash", "previous", "index", "height", "status", "fault").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted((tuple(r) for r in audited(blocks, digest).select("chain", "hash", "previous", "index", "height", "status", "fault").collect()), key=str) and len(found) == len(rows)
    assert {r[5] for r in found} == {"main", "fork", "orphan", "cycle", None}
    assert audited(blocks.where("index < 0"), digest, in_place=True).collect() == []


def test_events_are_read_once(spark):
    lines = entry_points.queries()["authenticity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("FileScan" in line for line in lines) == 1 and sum("Exchange" in line for line in lines) <= 2
