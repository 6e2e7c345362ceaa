"""Windows over tables and over streams give the same."""

import time

from pyspark.sql import functions as F

from lakescan.streaming import ranged, run_available, session, stream_from, stream_of, watermarked

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = watermarked(stream_of(spark, str(tmp_path / "in"), events.schema, files_per_trigger=5), "ts", "10 minutes")
    run_available(ranged(stream, "ts", "1 day", [("count", "event_id", "n"), ("sum", "value", "v")], ["event_type"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["event_type"]): r["n"] for r in ranged(events, "ts", "1 day", [("count", "event_id", "n")], ["event_type"]).collect()}
    # A window is written when the watermark has passed its end, so the last day may still be open.
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 5


def test_sliding_and_session(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00")], "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r["k"], r["n"]) for r in session(df, "ts", "30 minutes", [("count", "k", "n")], ["k"]).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sum(r["n"] for r in ranged(df, "ts", "1 hour", [("count", "k", "n")], slide="30 minutes").collect()) == 8


def test_stream_of_another_source(spark, tmp_path):
    stream = stream_from(spark, "rate-micro-batch", rowsPerBatch="7", startTimestamp="0", advanceMillisPerBatch="1000", numPartitions="2")
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]
    q = stream.select("value").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while not q.recentProgress and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        q.stop()
    assert q.recentProgress and q.exception() is None
