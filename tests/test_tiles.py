import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import recurrence as rc
from driftloom.operators import reports


@pytest.fixture
def sets(spark):
    rng = np.random.default_rng(4)
    rows = [(int(w), "abc"[int(rng.integers(0, 3))] if rng.random() < 0.9 else None, i, [float(v) for v in rng.random(2)]) for i, w in enumerate(rng.integers(0, 11, 60))]
    return spark.createDataFrame([*rows, (20, "z", 99, [0.5, 0.5])], "win int, label string, proto_id long, center array<double>").cache()


@pytest.mark.parametrize("sides", [(512, 256), (2, 1)])
@pytest.mark.parametrize("metric", ["minimal_distance", "centroid_displacement"])
def test_all_pairs_equal_given_pairs(sets, monkeypatch, metric, sides):
    for module in (rc, reports):
        monkeypatch.setattr(module, "SIDES", sides)
    found = reports.compare_windows(sets, metric)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair and class
    centers = sets.groupBy("win", "label").agg(F.array(*[F.avg(F.col("center")[k]) for k in range(2)]).alias("center"))
    wins = sets.select("win").distinct()
    pairs = wins.withColumnRenamed("win", "win_a").join(wins.withColumnRenamed("win", "win_b"), F.col("win_a") < F.col("win_b"))
    given = reports.window_minimal_distances(sets, pairs=pairs) if metric == "minimal_distance" else rc.window_distances(centers, pairs=pairs)
    got, want = ({(r.win_a, r.win_b): r.distance for r in x.collect()} for x in (found, given))
    assert set(got) == set(want) and len(want) == 66 and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


def test_one_against_all_pairs_no_others(sets):
    plan = reports.compare_windows(sets, "centroid_displacement", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("side, kernel", [(512, 3), (4, 3), (3, 5), (1, 3), (2, 7)])
def test_smoothed_blocks_equal_smoothed_cells(spark, monkeypatch, side, kernel):
    """Distances smoothed inside tasks: no cell is shuffled, and the same as the matrix smoothed cell by cell, also where windows are missing."""
    from driftloom.operators import windows

    monkeypatch.setattr(rc, "SMOOTH", side)
    rng = np.random.default_rng(side + kernel)
    rows = [(int(w), c, [float(v) for v in rng.random(2)]) for w in range(13) for c in "abc" if w not in (5, 12) and rng.random() < 0.8]
    centers = spark.createDataFrame([*rows, (7, None, [0.1, 0.2])], "win int, label string, center array<double>").cache()
    found = rc.smoothed_matrix(centers, 13, kernel)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInPandas")[0]
    want = windows.median_filter_2d(rc.full_matrix(rc.window_distances(centers), 13), kernel)
    got, want = ({(r.i, r.j): r.smooth for r in x.collect()} for x in (found, want))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_smoothed_query_sends_no_cells(spark):
    from driftloom.plans.catalog import QUERIES

    plan = QUERIES["median_filtered_matrix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInPandas" in plan and "Aggregate" not in plan


def test_many_smoothed_blocks(spark, monkeypatch):
    monkeypatch.setattr(rc, "SMOOTH", 128)
    value = np.random.default_rng(8).random(1_100)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = rc.smoothed_matrix(spark.createDataFrame([(i, "a", [float(v)]) for i, v in enumerate(value)], "win int, label string, center array<double>"), 1_100, 3).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    wide = np.pad(np.abs(value[:, None] - value), 1, "edge")
    want = np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)), (2, 3))
    assert len(found) == want.size and not found.duplicated(["i", "j"]).any() and np.allclose(found["smooth"], want[found["i"], found["j"]], atol=1e-12)
