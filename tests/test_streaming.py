"""Streams: windows with watermarks, and the detector from batch to batch."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from outlyer.sources import readers
from outlyer.streaming import windows
from outlyer.streaming.detector import StreamConfig, StreamingDetector


def _write(spark, folder, k, shift):
    rng = np.random.default_rng(k)
    x = rng.normal(shift, 1, (400, 2))
    spark.createDataFrame(pd.DataFrame({"id": range(k * 400, k * 400 + 400), "a": x[:, 0], "b": x[:, 1]})).coalesce(1).write.mode("append").parquet(folder)


def test_detector_over_a_stream(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "det")
    for k, shift in enumerate((0.0, 0.0, 8.0)):
        _write(spark, src, k, shift)
        det = StreamingDetector(["a", "b"], home, StreamConfig(trees=10, samples=40, depth=6, keep=50))
        stream = readers.stream(spark, src, "id long, a double, b double", files=10)
        q = stream.writeStream.foreachBatch(det.handler).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    scores = [spark.read.parquet(f"{home}/v{k}/scores") for k in range(3)]
    assert [s.count() for s in scores] == [400, 400, 400]
    assert spark.read.parquet(f"{home}/v2/rows").count() == 50
    assert scores[2].first().replaced > 0


def test_tumbling_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    src = str(tmp_path / "events")
    events.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = windows.tumbling(stream, "ts", "1 day", ["event_type"], late="1 day").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_type, r.start): r.n for r in spark.table("tumbled").collect()}
    want = {(r.event_type, r.start): r.n for r in windows.tumbling(events, "ts", "1 day", ["event_type"]).collect()}
    assert got == want
