from pyspark.sql import functions as F

from driftloom.operators import detectors
from driftloom.streaming import detect


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_detection_equals_the_batch_fold(spark, tmp_path):
    rate = F.when(F.col("id") >= 1500, 0.6).otherwise(0.1)
    rows = spark.range(3000).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), ((F.shiftrightunsigned(F.xxhash64("id"), 11) / 2.0**53) < rate).cast("int").alias("err"))
    for k in range(3):
        rows.where(F.col("seq").between(k * 1000, k * 1000 + 999)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(detect.detect_stream(stream, "fhddm"), "found")
    batch = [(r.warned_at, r.detected_at) for r in detectors.detect(rows, "fhddm").collect()]
    assert [(r.warned_at, r.detected_at) for r in spark.table("found").orderBy("detected_at").collect()] == batch and batch


def test_windows(spark, tmp_path):
    rows = spark.range(250).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(detect.count_windows(stream, 100), "counted")
    assert [(r.win, r.n, r["mean"]) for r in spark.table("counted").orderBy("win").collect()] == [(0, 100, 49.5), (1, 100, 149.5)]
    events = stream.select(F.timestamp_seconds(F.col("seq") * 60).alias("ts"), F.lit("a").alias("label"), "value", F.lit("k").alias("key"))
    run(detect.time_windows(events, "1 hour", None, "1 minute"), "timed")
    assert {r.n for r in spark.table("timed").collect()} == {60}
    run(detect.sessions(events.where("cast(ts as long) < 3600 or cast(ts as long) > 9000"), "30 minutes", "1 minute"), "sessions")
    assert [r.n for r in spark.table("sessions").collect()] == [60]
