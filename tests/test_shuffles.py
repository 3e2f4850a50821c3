"""How often queries shuffle, told from their plans, and their rows against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"


def shuffles(frame):
    """Exchanges of the plan; those that are only used again do not count."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


#: by query: the exchanges that its plan may have at most
MOST = {"graph_counts": 1, "turtle_export": 1, "turtle_round_trip": 3, "qualified_cardinality": 21}


@pytest.mark.parametrize("name", MOST)
def test_shuffles(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = entry_points.queries()[name](spark, DATA)
        assert shuffles(frame) <= MOST[name]
        rows = [tuple(r) for r in frame.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(rows, key=str) == sorted(con.execute(entry_points.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name, most", [("by_participant", 2), ("kg_items", 2), ("kg_property_graph", 5)])
def test_items_are_shuffled_once(spark, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(entry_points.queries()[name](spark, DATA)) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
