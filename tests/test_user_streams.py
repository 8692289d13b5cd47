"""Detectors over the registered streams: the concept of every stream moves in the middle, and each detector sees it."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import detectors
from driftloom.plans import drifts
from driftloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def moves(spark):
    """The row of each stream at which the concept moves."""
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").where("ts < timestamp_ntz '2024-01-15'")
    return {r.event_type: r["count"] for r in rows.groupBy("event_type").count().collect()}


def test_all_detectors_find_the_move(spark, moves):
    found = QUERIES["detector_comparison"](spark, SF_DIR).unionByName(QUERIES["adwin_drifts"](spark, SF_DIR).withColumn("detector", F.lit("adwin"))).collect()
    for name in detectors.DETECTORS:
        for stream, at in moves.items():
            assert any(at <= r.detected_at < at + 200 for r in found if r.detector == name and r.stream_id == stream), (name, stream)


def test_localised_near_the_move(spark, moves):
    for r in QUERIES["drift_descriptions"](spark, SF_DIR).collect():
        if abs(r.detected_at - moves[r.stream_id]) < 200:
            assert r.detected_at - 300 <= r.start <= r.detected_at < r.end <= r.detected_at + 200 and r.rate_peak > 0.5


def test_streams_grow_with_the_table(spark):
    assert drifts.moved_errors(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/events.parquet").count()


def brute_start(errs, at, lookback=300):
    if at < 50:
        return 0
    first = max(0, at - lookback)
    part = errs[first:at]
    if len(part) < 20:
        return first
    head = min(50, len(part) // 4)
    base, s = sum(part[:head]) / head, 0.0
    for i in range(head, len(part)):
        s = max(0.0, s + part[i] - base - 0.1)
        if s > 1.5:
            return first + i
    return first + head


@pytest.mark.parametrize("at", [10, 49, 50, 70, 130, 400, 1999])
def test_start_by_cusum_as_defined(spark, at):
    import random

    rng = random.Random(at)
    errs = [int(rng.random() < (0.4 if i % 500 > 350 else 0.1)) for i in range(2000)]
    rows = spark.createDataFrame([("a", i, e) for i, e in enumerate(errs)], "stream_id string, seq long, err int")
    drift = spark.createDataFrame([("a", 0, at, at)], "stream_id string, drift long, warned_at long, detected_at long")
    assert detectors.start_by_cusum(rows, drift).first().start == brute_start(errs, at)
