import numpy as np
import pytest

from driftloom.operators import fields


def frame(spark, xy, values):
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(xy, values, strict=True))]
    return spark.createDataFrame(rows + [(len(rows), None, 1.0, 9.0)], "row_id long, u double, v double, p double")


@pytest.mark.parametrize("kind, k, per_bucket", [("even", 10, 4), ("normal", 10, 4), ("normal", 30, 1), ("clumps", 5, 1), ("line", 3, 4), ("few", 10, 4), ("same", 4, 2)])
def test_nearest_by_definition(spark, kind, k, per_bucket):
    rng = np.random.default_rng(4)
    xy = {
        "even": rng.uniform(0, 10, (400, 2)), "normal": rng.normal(size=(600, 2)) * [5, 1], "clumps": np.concatenate([rng.normal(c, 0.01, (80, 2)) for c in (0, 5, 100)]), "line": np.column_stack([rng.uniform(0, 1e4, 200), np.ones(200)]),
        "few": rng.uniform(0, 1, (6, 2)), "same": np.repeat([[1.0, 2.0], [3.0, 4.0]], 20, 0),
    }[kind]
    at = np.concatenate([rng.uniform(xy.min(0) - 3, xy.max(0) + 3, (25, 2)), xy[:2]])
    cells = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(at)], "i int, j int, u double, v double")
    found = {}
    for r in fields.nearest_points(cells, frame(spark, xy, np.zeros(len(xy))), k, per_bucket).collect():
        found.setdefault(r.i, {})[r.place] = r.row_id
    for i, c in enumerate(at):
        d2 = (xy[:, 0] - c[0]) ** 2 + (xy[:, 1] - c[1]) ** 2
        want = np.lexsort((np.arange(len(xy)), d2))[:k]
        assert [found[i][p] for p in range(1, len(want) + 1)] == want.tolist()


def test_field_by_definition(spark):
    rng = np.random.default_rng(1)
    xy, size, k, sigma = rng.normal(size=(300, 2)) * [5, 1], 15, 10, 0.6
    p = rng.random(300)
    found = np.zeros((size, size))
    for r in fields.interpolate(frame(spark, xy, p), ["p"], size, k, sigma).collect():
        found[r.i, r.j] = r.p
    u, v = (np.linspace(*np.quantile(xy[:, a], [0.01, 0.99]), size) for a in (0, 1))
    field = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            d = np.hypot(xy[:, 0] - u[i], xy[:, 1] - v[j])
            near = np.argsort(d)[:k]
            field[i, j] = (p[near] / d[near]).sum() / (1 / d[near]).sum()
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    kernel /= kernel.sum()
    for _ in range(2):
        padded = np.pad(field, ((2, 2), (0, 0)), mode="symmetric")
        field = sum(w * padded[d : d + size] for d, w in enumerate(kernel)).T
    assert np.abs(found - np.clip(field, 0, 1)).max() < 1e-9, np.argwhere(np.abs(found - np.clip(field, 0, 1)) > 1e-9)


def test_points_at_a_cell_count_alone(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 1.0)], "i int, j int, u double, v double")
    near = fields.nearest_points(cells, frame(spark, [(1, 1), (1, 1), (1.1, 1)], [0.0, 1.0, 9.0]), 3)
    assert fields.distance_weighted(near, ["p"]).first().p == 0.5


def test_empty(spark):
    assert fields.interpolate(frame(spark, [], []).where("false"), ["p"], 5).collect() == []
