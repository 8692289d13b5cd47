"""Permutation importance against its definition, and how much of it is moved and scored."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from driftloom.operators import importance


class Rule:
    """Stands for a model: class 1 where x + y > 0. Keeps what it was given."""

    def __init__(self):
        self.given = []

    def transform(self, rows):
        self.given.append(rows)
        one = (F.col("x") + F.col("y") > 0).cast("double")
        return rows.withColumns({"prediction": one, "probability": array_to_vector(F.array(1 - one, one)), "rawPrediction": one})


def by_definition(spark, rows, repeats, seed):
    """All rows in hash order, one value moved for each row; rows of equal features meet values with the share of each label."""
    frame = spark.createDataFrame([(float(a), float(b), k) for a, b, k in rows], "x double, y double, label int")
    got = frame.select("x", "y", "label", F.xxhash64(F.lit(seed), "x", "y").alias("h")).collect()
    got.sort(key=lambda r: ((r.h >> 54), r.h, r.x, r.y))
    x, labels, h = np.array([(r.x, r.y) for r in got]), np.array([np.nan if r.label is None else r.label for r in got]), np.array([r.h for r in got])
    share = {c: np.array([(labels[h == v] == c).mean() for v in h]) for c in (0, 1)}
    right = lambda z: sum(((z.sum(1) > 0) == c) @ share[c] for c in (0, 1)) / np.isfinite(labels).sum()
    rng, falls = np.random.default_rng(seed), {}
    for f, name in enumerate("xy"):
        for _ in range(repeats):
            z = x.copy()
            z[:, f] = np.roll(x[:, f], -int(rng.integers(1, max(len(x), 2))))
            falls.setdefault(name, []).append(right(x) - right(z))
    return frame, {k: (np.mean(v), np.std(v)) for k, v in falls.items()}


@pytest.mark.parametrize("kind", ["different", "few", "uneven", "one"])
def test_permutation_by_definition(spark, kind):
    rng = np.random.default_rng(3)
    x = {"different": rng.normal(size=(300, 2)), "few": rng.integers(-3, 4, (500, 2)), "uneven": np.vstack([np.tile([[1, -2]], (400, 1)), rng.normal(size=(90, 2))]), "one": np.ones((1, 2))}[kind]
    rows = [(a, b, None if i % 41 == 7 else int(a + 0.5 * b > 0)) for i, (a, b) in enumerate(x)]
    frame, want = by_definition(spark, rows, 5, 4)
    found = {r.feature: (r.importance, r.deviation) for r in importance.permutation_importance(Rule(), frame, ["x", "y"], repeats=5, seed=4).collect()}
    assert set(found) == {"x", "y"} and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_work_grows_with_different_rows(spark):
    """20,000 rows with 12 different values of the features: no row for each row and repeat is made."""
    frame = spark.range(20_000).select((F.col("id") % 3 - 1).alias("x"), (F.col("id") % 4 - 1.5).alias("y"), (F.col("id") % 2).alias("label"))
    model = Rule()
    importance.permutation_importance(model, frame, ["x", "y"], repeats=10).collect()
    assert sum(rows.count() for rows in model.given) < 12 * 20 * 6


def test_permutation_of_nothing(spark):
    frame = spark.createDataFrame([], "x double, y double, label int")
    assert importance.permutation_importance(Rule(), frame, ["x", "y"], repeats=2).collect() == []


@pytest.mark.parametrize("part_rows, most", [(100, 150), (1000, 1000)])
def test_fit_spreads_large_partitions(spark, monkeypatch, part_rows, most):
    """No task of a fit keeps far more than PART_ROWS rows; smaller partitions stay as they are."""
    monkeypatch.setattr(importance, "PART_ROWS", part_rows)
    frame = spark.range(1000).coalesce(1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    seen = []

    class Forest(importance.RandomForestClassifier):
        def fit(self, data):
            seen.append(data.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())
            return super().fit(data)

    monkeypatch.setattr(importance, "RandomForestClassifier", Forest)
    model = importance.fit(frame, ["x", "y"], trees=3, depth=3)
    assert seen[0][1] == 1000 and (seen[0][0] <= most if part_rows < 1000 else seen[0][0] == 1000)
    assert importance.score(model, frame, ["x", "y"]).where("prediction = label").count() > 950
