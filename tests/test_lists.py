"""Keys that are lists: followed graph by graph as the rounds of joins rank them, without shuffling quads."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_points
from quarry.operators.lists import FIRST, HAS_KEY, NIL, REST, class_keys, class_keys_by_graph
from quarry.plans import structures

DATA = "/root/testdata/sf0.001"


def test_odd_lists(spark):
    cells = lambda k, items, end: [q for i, x in enumerate(items) for q in ((f"{k}{i}", FIRST, x), (f"{k}{i}", REST, f"{k}{i + 1}" if i + 1 < len(items) else end))]
    graphs = {
        "plain": [*cells("a", "xyzyx", NIL), ("c", HAS_KEY, "a0"), ("c", HAS_KEY, "a0"), ("c", HAS_KEY, "a3"), ("d", HAS_KEY, "a0"), (None, HAS_KEY, "a4")],
        "shared": [*cells("b", "xyz", NIL), *cells("e", "uv", "b1"), ("c", HAS_KEY, "b0"), ("c", HAS_KEY, "e0")],
        "cycles": [*cells("f", "xyz", "f0"), *cells("g", "u", "f1"), ("self", REST, "self"), *[("c", HAS_KEY, h) for h in ("f2", "g0", "self")]],
        "odd": [("h0", FIRST, "x"), ("h0", FIRST, "y"), ("h0", FIRST, None), ("h0", REST, "h1"), ("h0", REST, "h2"), ("h0", REST, None), ("h1", REST, "h2"), ("h2", FIRST, "z"), ("h2", REST, "gone"), *[("c", HAS_KEY, h) for h in ("h0", "nowhere", NIL, None)]],
        "none": [("c", "urn:p", "o")],
        None: [*cells("k", "xy", NIL), ("c", HAS_KEY, "k0")],
    }
    quads = spark.createDataFrame([(g, *q) for g, rows in graphs.items() for q in rows], "g string, s string, p string, o string")
    found = sorted((tuple(r) for r in class_keys_by_graph(quads.repartition("g"), "g").collect()), key=str)
    assert found == sorted((tuple(r) for r in class_keys(quads.drop("g")).collect()), key=str) and len(found) == 26
    assert class_keys_by_graph(quads.where("g = 'none'"), "g").collect() == []


@pytest.mark.parametrize("most", [structures.MOST, 40, 5])
def test_key_lists_shuffle_line_items_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(structures, "MOST", most)
    day = datetime.datetime(1997, 1, 1)
    rows = [(o, o % 7, s, n, day) for s in (1, 2, 30) for o in range(10 * s if s < 30 else 60) for n in (2, 1)] + [(0, 4, 1, 1, day), (3, 1, 9, 1, day), (3, 1, 9, 1, day)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    frame = entry_points.queries()["key_lists"](spark, str(tmp_path))
    if most == structures.MOST > 100:
        assert sum("Exchange" in line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(tuple(r) for r in frame.collect()) == sorted(con.execute(entry_points.oracle_sql()["key_lists"]).fetchall())
