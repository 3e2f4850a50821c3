import json

from pyspark.sql import functions as F

from quarry.sources import records
from quarry.streaming import events


def test_rates(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:01:10", "b", 4.0), ("2024-01-01 03:00:00", "c", 0.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = events.rates(events.of_types(stream, ["a", "b", "c"])).writeStream.format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("rates").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}


def test_in_order(spark, tmp_path):
    schema = "chain string, index long, timestamp string, hash string"
    batches = [[("x", 1, "t1", "h1"), ("x", 0, "t0", "h0")], [("x", 3, "t3", "h3"), ("x", 1, "t0", "other"), ("x", 0, "t9", "late")], [("x", 2, "t2", "h2"), ("x", 0, "t0", "h0")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = events.in_order(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["index"], r["hash"], r["action"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "h0", "append"), (1, "h1", "append"), (1, "other", "conflict"), (2, "h2", "append"), (3, "h3", "append")]


def test_records(spark, tmp_path):
    (tmp_path / "ndc.json").write_text(json.dumps({"results": [{"product_ndc": "1-2", "generic_name": "g", "brand_name": " ", "labeler_name": "Lab. Co", "dosage_form": "TABLET", "marketing_start_date": "20240131", "listing_expiration_date": "bad"}, {"product_ndc": None}]}))
    raw = records.arrays_of(spark.read.json(str(tmp_path / "ndc.json"), multiLine=True), ["results", "missing"])
    got = records.drugs(raw).collect()
    assert len(got) == 1 and got[0].record_id == "drug-ndc-1-2" and got[0].core.name == "g" and got[0].core.participant_id == "lab-co" and got[0].core.recorded_at == "2024-01-31T00:00:00Z" and got[0].attributes == {"dosage_form": "TABLET"}
    assert records.record_quads(records.drugs(raw)).count() == 8


def test_scale_chain(spark):
    rows = records.scale_chain(spark, 40).orderBy("tx").collect()
    assert len(rows) == 120 and rows[4].quantity == round((50 + 7) * 0.98, 4) and rows[2].next_tx is None and rows[0].next_tx == 1
