import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import reduce


def frame(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{n} double" for n in names)), names


def scores(rows, prefix, k):
    return np.array([[r[f"{prefix}{i + 1}"] for i in range(k)] for r in rows.orderBy("row_id").collect()])


def test_mixed_sources_come_back(spark):
    rng = np.random.default_rng(0)
    t = np.arange(3000)
    sources = np.column_stack([np.sign(np.sin(t / 17)), rng.laplace(size=3000), (t % 41) / 41.0 - 0.5])
    rows, names = frame(spark, sources @ rng.normal(size=(3, 5)) + 0.01 * rng.normal(size=(3000, 5)))
    found = scores(reduce.ica(rows, names, 3).transform(rows, "s"), "s", 3)
    like = np.abs(np.corrcoef(found.T, sources.T)[:3, 3:])
    assert (like.max(0) > 0.97).all() and sorted(like.argmax(0)) == [0, 1, 2]
    assert np.allclose(found.std(0), 1, atol=1e-6)


def test_planted_factors(spark):
    rng = np.random.default_rng(1)
    loadings, noise = rng.normal(size=(8, 2)), rng.uniform(0.1, 0.5, 8)
    hidden = rng.normal(size=(4000, 2))
    rows, names = frame(spark, hidden @ loadings.T + rng.normal(size=(4000, 8)) * np.sqrt(noise) + 3)
    found = reduce.factor_analysis(rows, names, 2)
    assert np.abs(found.loadings @ found.loadings.T - loadings @ loadings.T).max() < 0.25 and np.abs(found.noise - noise).max() < 0.06
    s = scores(found.scores.transform(rows, "f"), "f", 2)
    fitted = np.column_stack([s, np.ones(len(s))])
    left = hidden - fitted @ np.linalg.lstsq(fitted, hidden, rcond=None)[0]
    assert left.var() < 0.1 * hidden.var()


def test_distances_are_kept(spark):
    rng = np.random.default_rng(2)
    plane = rng.normal(size=(400, 2)) * [3, 1]
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0][:2]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(plane @ turn + 5)], "row_id long, x array<double>")
    z = scores(reduce.landmark_scaling(rows, 2, 30).transform(rows), "z", 2)
    far = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
    assert np.abs(far(z) - far(plane)).max() < 1e-6


def test_any_distance(spark):
    """Rows on a circle, by the angle between them: two directions show the circle."""
    angle = np.linspace(0, 1.5, 60)
    rows = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "row_id long, x array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    z = scores(reduce.landmark_scaling(rows, 1, 20, lambda a, b: F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))).transform(rows), "z", 1)
    assert np.abs(np.abs(z[:, 0] - z[0, 0]) - angle).max() < 1e-5


def test_too_few_directions(spark):
    rows, names = frame(spark, np.outer(np.arange(20.0), [1, 2]))
    with pytest.raises(ValueError, match="independent directions"):
        reduce.ica(rows, names, 2)
    with pytest.raises(ValueError, match="span fewer"):
        reduce.landmark_scaling(rows.select("row_id", F.array(*names).alias("x")), 2)


def test_moments_are_those_of_the_covariance_functions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + [0, 1e6, -3, 5]
    rows = spark.createDataFrame([(*[None if (i + j) % 7 == 0 and j < 3 else float(v) for j, v in enumerate(r)], None) for i, r in enumerate(x)], "a double, b double, c double, d double, e double")
    names = list("abcde")
    n, mean, cov = reduce._moments(rows, names)
    want = rows.agg(*[F.avg(f) for f in names], *[F.covar_pop(a, b) for a in names for b in names]).first()
    assert n == 500 and np.allclose(mean, np.array(want[:5], float), equal_nan=True)
    assert np.allclose(cov, np.array(want[5:], float).reshape(5, 5), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_moments_send_one_matrix(spark):
    """The plan of 64 features has no aggregate for each of their pairs."""
    seen = []
    rows, names = frame(spark, np.random.default_rng(5).normal(size=(50, 64)))
    agg = type(rows).agg
    try:
        type(rows).agg = lambda self, *e: seen.append(len(e)) or agg(self, *e)
        found = reduce.pca(rows, names)
    finally:
        type(rows).agg = agg
    assert max(seen) <= 65 and np.allclose(found.axes @ found.axes.T, np.eye(2))
