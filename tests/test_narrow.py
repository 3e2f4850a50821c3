"""What is shuffled and gathered, told from plans: narrow rows once, not quads; and odd rows against the SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"


def plan_of(spark, name, data=DATA):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return entry_points.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Items that repeat in whole or in part, with several batches, makers and days, and an order without a number."""
    day = lambda n: datetime.datetime(1997, 1, 1) + datetime.timedelta(days=n)
    rows = [(1, 1, "N", 1, 7, day(0)), (1, 1, "N", 1, 7, day(0)), (1, 1, "A", 2, 7, day(3)), (1, 2, "R", 2, 8, day(5)), (1, 12, "N", 1, 7, day(9)), (11, 1, "N", 3, 8, day(1)), (11, 1, "N", 3, 9, day(1)), (2, 3, "A", 1, 9, day(2))]
    path = tmp_path_factory.mktemp("odd")
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long, l_partkey long, l_shipdate timestamp_ntz"
    for folder, more in ((path, []), (path / "nameless", [(None, 1, "N", 1, 7, day(4))])):
        spark.createDataFrame(rows + more, schema).write.parquet(f"{folder}/lineitem.parquet")
    return path


def same_as_sql(spark, name, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet/*.parquet'")
    rows = [tuple(r) for r in entry_points.queries()[name](spark, str(data)).collect()]
    assert rows and sorted(rows, key=str) == sorted(con.execute(entry_points.oracle_sql()[name]).fetchall(), key=str)


def test_turtle_gathers_a_graph_once(spark, odd):
    assert sum("Aggregate(" in line for line in plan_of(spark, "turtle_export")) <= 2  # one grouping, in two steps
    same_as_sql(spark, "turtle_export", odd)


def test_stats_shuffle_no_subjects(spark, odd):
    lines = plan_of(spark, "dataset_stats")
    assert not any("Expand" in line and "s#" in line for line in lines)
    assert sum("Exchange hashpartitioning(l_orderkey" in line for line in lines) == 1
    same_as_sql(spark, "dataset_stats", odd)


def test_consistency_reads_line_items_once(spark, odd):
    lines = plan_of(spark, "triple_consistency")
    assert sum("FileScan" in line for line in lines) == 1 and sum("Exchange" in line for line in lines) == 1
    same_as_sql(spark, "triple_consistency", odd)
    same_as_sql(spark, "triple_consistency", odd / "nameless")


def test_analytics_shuffle_numbers(spark, odd):
    lines = plan_of(spark, "product_analytics")
    assert sum("Exchange hashpartitioning" in line for line in lines) == 2 and not any("Expand" in line for line in lines)
    same_as_sql(spark, "product_analytics", odd)
    same_as_sql(spark, "product_analytics", odd / "nameless")


def test_counts_read_line_items_once(spark, odd):
    lines = plan_of(spark, "count_cross_check")
    assert sum("FileScan" in line for line in lines) == 1 and sum("Exchange hashpartitioning" in line for line in lines) == 1
    same_as_sql(spark, "count_cross_check", odd)
    same_as_sql(spark, "count_cross_check", odd / "nameless")
