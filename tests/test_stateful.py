"""Operators with state give over several micro-batches, and after a restart, what their batch forms give at once."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import bayes, detectors
from driftloom.streaming import stateful


@pytest.fixture(scope="module")
def rows(spark):
    stateful.use_state_store(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # every partition has a state store with files of its own
    rng, out = random.Random(1), []
    for s in ("a", "b"):
        for i in range(900):
            label = rng.randint(0, 2)
            shift = 3.0 if i > 500 else 0.0
            out.append((s, i, None if i % 97 == 5 else label, None if i % 101 == 7 else rng.gauss(label * 2 + shift, 1), rng.gauss(-label, 2), int(rng.random() < (0.6 if i > 500 else 0.1)), float(i % 13)))
    yield spark.createDataFrame(out, "stream_id string, seq long, label int, x double, y double, err int, value double").cache()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def stream(spark, rows, folder, op):
    """Rows in three micro-batches of mixed order; before the last the query stops and starts anew from its checkpoint."""
    source, sink, check = (str(folder / x) for x in ("in", "out", "check"))
    for parts in ((0, 1), (2,)):
        for k in parts:
            rows.where(F.floor(F.col("seq") / 300) == k).orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(source)
        arriving = op(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet")
        arriving.option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(sink).collect()), key=repr)


def test_detector(spark, rows, tmp_path):
    found = stream(spark, rows, tmp_path, lambda s: stateful.detect_stream(s.select("stream_id", "seq", "err"), "hddm_w"))
    batch = [(r.stream_id, r.warned_at, r.detected_at) for r in detectors.detect(rows, "hddm_w").collect()]
    assert found == sorted(batch, key=repr) and batch


def test_learner(spark, rows, tmp_path):
    found = stream(spark, rows, tmp_path, lambda s: stateful.prequential_stream(s.select("stream_id", "seq", "label", "x", "y"), ["x", "y"]))
    batch = bayes.prequential(rows, ["x", "y"]).select("stream_id", "seq", "label", "predicted", "err").collect()
    assert found == sorted(map(tuple, batch), key=repr)


def test_sliding(spark, rows, tmp_path):
    found = stream(spark, rows, tmp_path, lambda s: stateful.sliding_windows(s.select("stream_id", "seq", "value"), 100, 40))
    values = [float(i % 13) for i in range(900)]
    want = [(s, k, 40 * k + 99, sum(values[40 * k : 40 * k + 100]) / 100) for s in "ab" for k in range(21)]
    assert found == sorted(want, key=repr)


def test_idle_streams_are_forgotten(spark, rows, tmp_path):
    import time

    source = str(tmp_path / "in")
    put = lambda low: rows.where(f"stream_id = 'a' and seq >= {low} and seq < {low + 10}").select("stream_id", "seq", "value").coalesce(1).write.mode("append").parquet(source)
    put(0)
    arriving = spark.readStream.schema("stream_id string, seq long, value double").parquet(source)
    query = stateful.sliding_windows(arriving, 5, 5, 1000).writeStream.format("memory").queryName("slid").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while spark.table("slid").count() < 2 and time.time() < until:
            time.sleep(0.5)
        time.sleep(8)
        put(10)
        while spark.table("slid").count() < 4 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r.win, r.last) for r in spark.table("slid").collect()) == [(0, 4), (0, 14), (1, 9), (1, 19)]


def brute(rows, width=bayes.WIDTH):
    out, known = [], {}
    for r in rows:
        x = [r.x, r.y]
        best = None
        if known and None not in x:
            best = min(known, key=lambda c: (-bayes.joint_log(*known[c], x, width), c))
        out.append((r.stream_id, r.seq, r.label, best, int(best is None or best != r.label)))
        if None not in (r.label, *x):
            n, s, q = known.get(r.label, (0, [0.0, 0.0], [0.0, 0.0]))
            known[r.label] = (n + 1, [a + b for a, b in zip(s, x, strict=True)], [a + b * b for a, b in zip(q, x, strict=True)])
    return out


@pytest.mark.parametrize("segment", [65_536, 70])
def test_batch_learner_by_definition(spark, rows, monkeypatch, segment):
    from driftloom.operators import ordered

    monkeypatch.setattr(ordered, "SEGMENT", segment)
    found = sorted(map(tuple, bayes.prequential(rows, ["x", "y"]).collect()), key=repr)
    data = sorted(rows.collect(), key=lambda r: (r.stream_id, r.seq))
    want = [t for s in "ab" for t in brute([r for r in data if r.stream_id == s])]
    assert found == sorted(want, key=repr)


def test_empty(rows):
    assert bayes.prequential(rows.where("false"), ["x"]).collect() == []
