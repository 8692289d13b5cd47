import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from driftloom.operators import importance, shapley


def exact(value, x, back):
    """Shapley values from their definition."""
    d = len(x)
    v = {}
    for r in range(d + 1):
        for s in combinations(range(d), r):
            mixed = back.copy()
            mixed[:, list(s)] = x[list(s)]
            v[s] = value(mixed).mean()
    phi = np.zeros(d)
    for i in range(d):
        for s in v:
            if i not in s:
                phi[i] += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (v[tuple(sorted((*s, i)))] - v[s])
    return v[()], phi


def curved(x):
    return np.sin(x[:, 0]) * x[:, 1] + x[:, 2] * x[:, 3] * x[:, 4] + x[:, 5] ** 2 - 0.3 * x[:, 6] * x[:, 7]


def curved_column(cells):
    x = [F.get("x", F.lit(i)) for i in range(8)]
    return cells.withColumn("value", F.sin(x[0]) * x[1] + x[2] * x[3] * x[4] + x[5] * x[5] - 0.3 * x[6] * x[7])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return rng.normal(size=(12, 8)), rng.normal(size=(9, 8))


def frames(spark, x, back):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>"), spark.createDataFrame([(r.tolist(),) for r in back], "x array<double>")


@pytest.mark.parametrize("budget, error", [(254, 1e-9), (2064, 1e-9), (120, 0.12), (60, 0.2)])
def test_near_the_definition(spark, data, budget, error):
    """All coalitions: exact. Half of them or fewer: values within `error` on average, in units of the scores' spread."""
    x, back = data
    found = {r.row_id: r for r in shapley.kernel_shap(curved_column, *frames(spark, x, back), 8, budget).collect()}
    want = [exact(curved, r, back) for r in x]
    spread = curved(x).std()
    for i, (base, phi) in enumerate(want):
        assert abs(found[i].base - base) < 1e-9
        assert abs(sum(found[i].phi) + found[i].base - curved(x[i : i + 1])[0]) < 1e-9  # values always sum up
    assert np.mean([np.abs(np.array(found[i].phi) - phi).mean() for i, (_, phi) in enumerate(want)]) <= error * spread


@pytest.mark.parametrize("d, budget", [(1, 10), (2, 10), (40, 120), (40, 2000)])
def test_linear_is_exact(spark, d, budget):
    rng = np.random.default_rng(d)
    w, x, back = rng.normal(size=d), rng.normal(size=(5, d)), rng.normal(size=(4, d))
    score = lambda cells: cells.withColumn("value", sum(F.get("x", F.lit(i)) * float(w[i]) for i in range(d)))
    for r in shapley.kernel_shap(score, *frames(spark, x, back), d, budget).collect():
        assert np.allclose(r.phi, w * (x[r.row_id] - back.mean(0)), atol=1e-8)


def test_coalitions():
    masks, weights = shapley.coalitions(6, 62)
    assert len({m.tobytes() for m in masks}) == 62
    assert all(abs(w - 5 / (math.comb(6, m.sum()) * m.sum() * (6 - m.sum()))) < 1e-12 for m, w in zip(masks, weights, strict=True))
    masks, weights = shapley.coalitions(30, 500, 3)
    assert len(masks) <= 500 and {m.tobytes() for m in masks} == {(~m).tobytes() for m in masks}
    assert abs(weights.sum() - sum(29 / (s * (30 - s)) for s in range(1, 30))) < 1e-9


def test_importance_of_many_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12))
    names = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame([(*map(float, r), int(r[3] + 0.3 * r[7] > 0)) for r in x], ", ".join(f"{n} double" for n in names) + ", label int")
    found = {r.feature: r.importance for r in importance.shap_importance(importance.fit(rows, names), rows, names, background=8, sample=15, budget=150).collect()}
    assert set(found) == set(names) and sorted(found, key=found.get)[-2:] == ["f7", "f3"]


def test_empty(spark):
    x, back = frames(spark, np.zeros((1, 3)), np.zeros((1, 3)))
    assert shapley.kernel_shap(lambda c: c.withColumn("value", F.lit(1.0)), x.where("false"), back, 3).collect() == []


@pytest.mark.parametrize("budget", [254, 60])
def test_arrays_like_columns(spark, data, budget):
    """Scored in numpy inside tasks: the same values, with a null feature and a null row too, and no join, grouping or row for each coalition."""
    x, back = data
    rows, few = frames(spark, x, back)
    holes = spark.createDataFrame([(100, [None, *map(float, x[0, 1:])]), (101, None)], "row_id long, x array<double>")
    rows = rows.unionAll(holes)
    found = shapley.kernel_shap_arrays(curved, rows, few, 8, budget)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    found = {r.row_id: r for r in found.collect()}
    want = {r.row_id: r for r in shapley.kernel_shap(curved_column, rows, few, 8, budget).collect()}
    assert set(found) == set(want)
    for k, r in want.items():
        assert found[k].base == pytest.approx(r.base, abs=1e-12) and [v is None for v in found[k].phi] == [v is None for v in r.phi] and np.allclose(np.array(found[k].phi, float), np.array(r.phi, float), atol=1e-9, equal_nan=True)


def test_explained_vectors_are_not_multiplied(spark):
    """shap_linear_vectors: no join and no row for each coalition and background row."""
    from driftloom.plans.catalog import QUERIES

    plan = QUERIES["shap_linear_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_arrays_of_nothing(spark):
    x, back = frames(spark, np.zeros((1, 3)), np.zeros((1, 3)))
    assert shapley.kernel_shap_arrays(lambda m: m.sum(1), x.where("false"), back, 3).collect() == []
    assert shapley.kernel_shap_arrays(lambda m: m.sum(1), x, back.where("false"), 3).collect() == []


class Curve:
    """Stands for a model: the probability of class 1 is x y / 100."""

    def transform(self, rows):
        x = vector_to_array("_x")
        p = x[0] * x[1] / 100
        return rows.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def test_importance_counts_every_row(spark):
    """900 rows, most of them equal, and a few far off that a sample of 500 or a background of 100 may leave out."""
    rng = np.random.default_rng(4)
    rows = [*[(1.0, 2.0)] * 700, *[tuple(map(float, r)) for r in rng.integers(0, 8, (195, 2))], *[(9.0, 9.0 + i / 8) for i in range(5)]]
    x = np.array(rows)
    phi = np.array([exact(lambda z: z[:, 0] * z[:, 1] / 100, r, x)[1] for r in x])
    found = {r.feature: r for r in importance.shap_importance(Curve(), spark.createDataFrame(rows, "a double, b double").repartition(3), ["a", "b"]).collect()}
    for i, f in enumerate("ab"):
        assert found[f].importance == pytest.approx(np.abs(phi[:, i]).mean(), abs=1e-12) and found[f].deviation == pytest.approx(np.abs(phi[:, i]).std(), abs=1e-12)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_blocks_and_weights(spark, data, monkeypatch, block):
    """Background rows that stand for several, in blocks of any size, give what the repeated rows give."""
    monkeypatch.setattr(shapley, "BLOCK", block)
    x, back = data
    rows, _ = frames(spark, x[:4, :3], back)
    times = [1, 4, 2, 3]
    weighted = spark.createDataFrame([(b[:3].tolist(), k) for b, k in zip(back, times, strict=False)], "x array<double>, n long")
    score = lambda cells: cells.withColumn("value", F.sin(F.get("x", F.lit(0))) * F.get("x", F.lit(1)) + F.get("x", F.lit(2)) ** 2)
    repeated = np.repeat(back[:4, :3], times, 0)
    for r in shapley.kernel_shap(score, rows, weighted, 3).collect():
        base, phi = exact(lambda z: np.sin(z[:, 0]) * z[:, 1] + z[:, 2] ** 2, x[r.row_id, :3], repeated)
        assert r.base == pytest.approx(base, abs=1e-9) and np.allclose(r.phi, phi, atol=1e-9)
