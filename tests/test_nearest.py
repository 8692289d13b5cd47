import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import nearest as nn
from driftloom.operators import recurrence as rc


def brute(x, y):
    with np.errstate(all="ignore"):
        d = np.array([nn.exact_distances(np.broadcast_to(r, y.shape), y) for r in x])
    at = np.where(np.isnan(d), np.inf, d).argmin(1)
    return at, d[np.arange(len(x)), at]


@pytest.mark.parametrize("rows,targets", [(1024, 2048), (7, 5)])
def test_kernel_by_definition(monkeypatch, rows, targets):
    monkeypatch.setattr(nn, "ROWS", rows)
    monkeypatch.setattr(nn, "TARGETS", targets)
    monkeypatch.setattr(nn, "EXACT", 11)
    rng = np.random.default_rng(3)
    y = np.r_[rng.integers(0, 3, (40, 3)), rng.random((20, 3)) + 1e6].astype(float)
    y = np.r_[y, y[:10], y + 1e-9]
    x = np.r_[rng.integers(0, 3, (30, 3)), y[:50] + 1e-12, [[np.nan, 0, 0], [np.inf, 1, 1]]].astype(float)
    for targets in (y, np.r_[[[np.nan, 1, 1]], y]):
        got, want = nn.nearest(x, targets), brute(x, targets)
        assert (got[0] == want[0]).all() and np.array_equal(got[1], want[1], equal_nan=True)


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, i % 3, [float(v) for v in rng.integers(0, 6, 4)]) for i in range(300)], "row_id long, label int, center array<double>")


@pytest.mark.parametrize("at_once", [65_536, 7])
def test_nearest_prototype(points, monkeypatch, at_once):
    monkeypatch.setattr(rc, "MAX_PROTOTYPES", at_once)
    protos = points.where("row_id % 4 = 0").select(F.col("row_id").alias("proto_id"), F.col("label").alias("class"), "center")
    found = rc.nearest_prototype(points, protos)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # the set of prototypes is no column of a row
    sets = sorted((p.proto_id, p["class"], p.center) for p in protos.collect())
    want = {r.row_id: min((float(nn.exact_distances(np.array([r.center]), np.array([c]))[0]), i, k) for i, k, c in sets) for r in points.collect()}
    assert {r.row_id: (r.distance, r.proto_id, r.proto_class) for r in found.collect()} == want
    assert rc.nearest_prototype(points, protos.where("proto_id < 0")).where("proto_id is null").count() == 300


@pytest.mark.parametrize("block", [4_096, 9])
def test_minimal_distance_in_blocks(points, monkeypatch, block):
    monkeypatch.setattr(rc, "BLOCK", block)
    sets = points.withColumnsRenamed({"row_id": "proto_id", "label": "class"}).where("class < 2 or proto_id < 200")
    a, b = sets.where("proto_id % 5 = 0 and class > 0 or proto_id % 5 > 0 and class = 0"), sets.where("proto_id % 5 > 0 and class > 0")
    sides = [{c: [r.center for r in s.collect() if r["class"] == c] for c in range(3)} for s in (a, b)]
    found = rc.minimal_distance(a, b)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()  # blocks meet blocks, rows don't
    for r in found.collect():
        few, many = sorted((s[r["class"]] for s in sides), key=len)
        mean = np.mean([min(np.linalg.norm(np.subtract(x, y)) for y in many) for x in few]) if few and many else 0
        assert r.distance == pytest.approx(mean + 2.0 * (len(many) - len(few)))
    assert found.count() == 3
