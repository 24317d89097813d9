from pyspark.sql import functions as F

from tradewinds.streaming import ingest


def test_windows_and_gate(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 10:00:00", "p", "c", 2.0, "exp", "2024-01"), ("2024-01-01 11:00:00", "p", "c", 3.0, "exp", "2024-01"), ("2024-01-05 00:00:00", "p", "c", 1.0, "exp", "2024-01")]
    df = spark.createDataFrame(rows, "ts string, product string, partner string, value double, flow string, period string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    schema = "ts timestamp, product string, partner string, value double, flow string, period string"
    q = ingest.late_panel(ingest.arrivals(spark, src, schema)).writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.value for r in spark.table("late").collect()) == [1.0, 5.0]
    for name, ok in (("a", True), ("b", False)):
        ingest.gated_months(ingest.arrivals(spark, src, schema), str(tmp_path / name), str(tmp_path / f"ck{name}"), lambda b, ok=ok: ok).awaitTermination()
        assert (tmp_path / name / ("store" if ok else "rejected")).exists()


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    schema = "ts timestamp, product string, partner string, value double, flow string, period string"
    src, store, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [("2024-01-01 10:00:00", "p", "c", 2.0, "exp", "2024-01"), ("2024-02-01 11:00:00", "p", "c", 3.0, "exp", "2024-02")]
    spark.createDataFrame(rows, "ts string, product string, partner string, value double, flow string, period string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    for _ in range(2):
        ingest.gated_months(ingest.arrivals(spark, src, schema), store, checkpoint, lambda b: True).awaitTermination()
        for name in ("commits/0", "commits/.0.crc"):  # as if the driver had died before it noted the batch
            (tmp_path / "ck" / name).unlink(missing_ok=True)
    assert spark.read.parquet(f"{store}/store").count() == 2
