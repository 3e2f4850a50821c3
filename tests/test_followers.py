"""Streams that keep tables up to date: restarts and repeated batches give what one batch over all rows gives."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators.knowledge import Kind, edges, entities
from quarry.operators.ledger import merkle_root
from quarry.streaming.events import in_order
from quarry.streaming.graph import GraphFollower, RootFollower, follow
from quarry.streaming.monitor import Rule, alerts, channels

QUADS = "g string, s string, p string, o string"
TYPE, LABEL = "urn:type", "urn:label"
KINDS = [Kind(("urn:c#Batch",), {"urn:id": "batchId"}, 0.9), Kind(("urn:c#Farm",), {}, 0.95)]


def quads():
    out = []
    for i in range(30):
        out += [("g", f"b{i % 12}", TYPE, "urn:c#Batch"), ("g", f"b{i % 12}", "urn:id", f"id{i:02}"), ("g", f"b{i}", "urn:from", f"f{i % 4}"), ("g", f"f{i % 4}", TYPE, "urn:c#Farm"), ("g", f"f{i % 4}", LABEL, f"Farm {i:02}")]
    return out


def plain(df):
    return sorted(repr(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)) for r in df.collect())


def test_graph_follows_and_survives_restarts(spark, tmp_path):
    rows = quads()
    for k in range(5):
        spark.createDataFrame(rows[k * 30 : (k + 1) * 30], QUADS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = lambda n: spark.readStream.schema(QUADS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(*[f"{tmp_path}/in"])
    follower = GraphFollower(f"{tmp_path}/graph", KINDS, {"urn:from": 0.9}, TYPE, LABEL)
    seen = []

    def failing(batch, number):
        follower(batch, number)
        seen.append(number)
        if len(seen) == 3:
            raise RuntimeError("lost after the batch was written")

    query = follow(source(0), failing, f"{tmp_path}/check").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after"):
        query.awaitTermination()
    follow(source(0), follower, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame(rows, QUADS)
    assert plain(follower.entities(spark)) == plain(entities(whole, KINDS, TYPE, LABEL))
    assert plain(follower.edges(spark)) == plain(edges(whole, {"urn:from": 0.9}))
    reports = follower.reports(spark).agg(F.count(F.lit(1)), F.sum("new_entities"), F.sum("new_edges")).first()
    assert tuple(reports) == (5, entities(whole, KINDS, TYPE, LABEL).count(), edges(whole, {"urn:from": 0.9}).count())


def test_root_follows(spark, tmp_path):
    follower, all_ = RootFollower(str(tmp_path / "root")), []
    for k in range(3):
        part = [f"{(i * 7919) % 1000:064x}" for i in range(k * 13, (k + 1) * 15)]
        all_ += part
        for _ in range(2):  # the batch comes twice
            follower(spark.createDataFrame([(h,) for h in [*part, None]], "hash string"), k)
        want = merkle_root(spark.createDataFrame([(h,) for h in sorted(set(all_))], "hash string")).first()["root"]
        assert {r["batch"]: r["root"] for r in follower.roots(spark).collect()}[k] == want


def test_alerts_come_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = pd.Timestamp("2024-01-01 00:00:00")
    at = lambda s: (start + pd.Timedelta(seconds=s)).to_pydatetime()
    batches = [
        [("cpu", at(0), 50.0), ("cpu", at(1), 95.0), ("mem", at(1), 1.0), ("cpu", None, 99.0)],
        [("cpu", at(2), 96.0), ("cpu", at(3), 97.0), ("cpu", at(4), 98.0)],
        [("cpu", at(5), 10.0), ("cpu", at(6), 20.0)],
        [("cpu", at(200), 99.0)],
        [("other", at(400), 0.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "metric string, at timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        rules = {"cpu": Rule(most=90, in_a_row=2, silent=1000), "mem": Rule(least=0.5, silent=60)}
        stream = spark.readStream.schema("metric string, at timestamp, value double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        found = alerts(stream, rules, history=3, late="0 seconds")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = channels(spark.read.parquet(f"{tmp_path}/out"), {"mem"}).orderBy("at", "metric").collect()
    assert [(r["metric"], r["kind"], r["channel"]) for r in got] == [("mem", "silent", "page"), ("cpu", "breach", "mail"), ("cpu", "cleared", "log")]
    assert got[1]["value"] == 96.0 and abs(got[1]["mean"] - (50 + 95 + 96) / 3) < 1e-9


def test_order_with_bounded_state(spark, tmp_path):
    schema = "chain string, index long, timestamp string, hash string"
    rows = [("c", i, f"t{i:03}", f"h{i}") for i in range(20)] + [("c", 2, "t000", "other"), ("c", 19, "t000", "other")]
    for k, part in enumerate((rows[10:20], rows[:10], rows[20:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        in_order(stream, remember=5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["index"], r["action"]) for r in got) == sorted([(i, "append") for i in range(20)] + [(19, "conflict")])
