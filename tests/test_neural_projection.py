import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import boundary
from driftloom.operators.neural_projection import Network, NeuralPlane

NAMES = ["a", "b", "c", "d"]


def test_slopes_are_differences():
    rng = np.random.default_rng(0)
    net = Network.random(5, 3, (7, 4), rng)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape)
    x, y = rng.random((9, 5)), rng.integers(0, 3, 9)
    _, slopes = net.loss_and_gradients(x, y)
    for p, g in zip(net.parameters(), slopes, strict=True):
        assert p.shape == g.shape
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            kept, h = p[at], 1e-6
            p[at] = kept + h
            up = net.loss_and_gradients(x, y)[0]
            p[at] = kept - h
            down = net.loss_and_gradients(x, y)[0]
            p[at] = kept
            assert abs((up - down) / (2 * h) - g[at]) < 1e-6


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 900)
    centers = rng.uniform(-5, 5, (3, 4))
    x = centers[label] + rng.normal(0, 0.6, (900, 4))
    return spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))], "row_id long, a double, b double, c double, d double, label int")


@pytest.fixture(scope="module")
def plane(rows):
    return NeuralPlane.fit(rows, NAMES, widths=(32, 16), epochs=60)


def test_classes_and_features_come_back(rows, plane):
    assert plane.losses[-1] < 0.7 * plane.losses[0]
    found = plane.classify(plane.transform(rows)).collect()
    assert np.mean([r.predicted == r.label for r in found]) > 0.95 and all(-1 <= r.u <= 1 and 1 / 3 <= r.predicted_p <= 1 for r in found)
    back = {r.row_id: r for r in plane.inverse(plane.transform(rows).select("row_id", "u", "v")).collect()}
    given = np.array([[r[c] for c in NAMES] for r in rows.orderBy("row_id").collect()])
    made = np.array([[back[i][c] for c in NAMES] for i in range(len(given))])
    assert ((made - given) ** 2).mean() < 0.35 * given.var(0).mean()
    assert (made >= given.min(0) - 1e-9).all() and (made <= given.max(0) + 1e-9).all()


def test_nulls_and_empty(rows, plane):
    some = rows.withColumn("b", F.when(F.col("row_id") == 4, None).otherwise(F.col("b"))).where("row_id < 9")
    assert [r.row_id for r in plane.transform(some).collect() if r.u is None] == [4]
    assert plane.transform(rows.where("false")).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        NeuralPlane.fit(rows.where("false"), NAMES)


def test_boundary_takes_it(rows, plane):
    models = [boundary.classifier(rows.withColumn("label", (F.col("label") == k).cast("int")), NAMES, trees=5, depth=3) for k in (0, 1)]
    marked = boundary.disagreement_map(rows, NAMES, *models, size=15, projector=plane)
    assert marked.count() == 225 and 0 < marked.where("differ = 1").count() < 225
