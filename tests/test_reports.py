"""Classifier presets, rules in a table's units, matched labels, neighbours, splits and starts, against hand-worked cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import boundary, classifiers, clusters, detectors, ordered, prototypes, reports


@pytest.fixture(scope="module")
def square(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    return spark.createDataFrame([(i, x, y, int(x > 0.5)) for i, x, y in rows], "row_id long, x double, y double, label int")


@pytest.mark.parametrize("preset", sorted(classifiers.PRESETS))
def test_presets(square, preset, tmp_path):
    model = classifiers.fit(square, ["x", "y"], preset=preset)
    assert classifiers.accuracy(model, square).first().accuracy > 0.9
    classifiers.save(model, str(tmp_path / "m"))
    again = classifiers.with_classes(classifiers.load(str(tmp_path / "m")), square).select("row_id", "predicted")
    assert sorted(again.collect()) == sorted(classifiers.with_classes(model, square).select("row_id", "predicted").collect())


def test_unknown_preset(square):
    with pytest.raises(ValueError):
        classifiers.fit(square, ["x"], preset="none")


def test_rules_in_units(square):
    marked = square.withColumn("differ", ((F.col("x") > 0.5) & (F.col("y") <= 0.5)).cast("int"))
    rules, placed = boundary.drift_rules(marked, ["x", "y"])
    assert boundary.ordered_rules(rules).orderBy("place").first().confidence > 0.9
    box = {r.feature: r for r in boundary.unscaled(rules.orderBy(F.desc("coverage")).limit(1), placed, ["x", "y"], {"x": 10.0, "y": 0.0}, {"x": 2.0, "y": 1.0}).collect()}
    assert box["x"].low > 10.9 and box["x"].high <= 12 and box["y"].high < 0.56 and 0.1 < box["x"].area < 0.4


def test_matching_equals_the_best_permutation(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(4)}", rng.randrange(5)) for _ in range(300)] + [("u0", -1)] * 20
    found = reports.clustering_accuracy(spark.createDataFrame(rows, "u string, v int"), "u", "v", -1).first()
    n = lambda u, v: sum(1 for a, b in rows if a == u and b == v)
    best = max(sum(n(f"u{i}", p[i]) for i in range(4)) for p in itertools.permutations(range(5), 4))
    assert found.accuracy == pytest.approx(best / 300) and found.accuracy_with_outliers == pytest.approx(best / 300 * (1 - 20 / 320))


def test_nearest_rows(spark, square, monkeypatch):
    monkeypatch.setattr(reports, "MAX_POINTS", 7)
    rows = square.select("row_id", F.array("x", "y").alias("center"))
    points = rows.where("row_id < 20").withColumnRenamed("row_id", "point_id")
    got = {(r.point_id, r.place): r.row_id for r in reports.nearest_rows(points, rows.repartition(5), 3).collect()}
    all_ = {r.row_id: r.center for r in rows.collect()}
    for p in range(20):
        want = sorted(all_, key=lambda i: (sum((a - b) ** 2 for a, b in zip(all_[i], all_[p], strict=True)), i))[:3]
        assert [got[p, k] for k in (1, 2, 3)] == want


def test_nearest_rows_hold_few_distances(spark, monkeypatch):
    """Ties and many batches; distances of a whole batch to all points are never a table."""
    monkeypatch.setattr(reports, "MEET", 16)
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.array((F.col("id") * 7 % 10).cast("double"), (F.col("id") % 3).cast("double")).alias("center"))
    points = rows.where("row_id % 8 = 0").withColumnRenamed("row_id", "point_id")
    all_ = {r.row_id: r.center for r in rows.collect()}
    found = {}
    for r in reports.nearest_rows(points, rows.repartition(3), 5).collect():
        found.setdefault(r.point_id, {})[r.place] = (r.distance, r.row_id)
    for p in range(0, 400, 8):
        want = sorted((sum((a - b) ** 2 for a, b in zip(c, all_[p], strict=True)) ** 0.5, i) for i, c in all_.items())[:5]
        assert [found[p][k] for k in range(1, 6)] == want


def test_capped_split_and_positions(square):
    parts = {(r.label, r.part): r.n for r in reports.capped_split(square, "label", "row_id", 0.9, 100).groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    assert abs(sum(n for (_, part), n in parts.items() if part == "train") - 100) <= 1
    assert [r.row_id for r in reports.at_positions(square, [5, 3, 5], "row_id").orderBy("row_id").collect()] == [3, 5]
    with pytest.raises(ValueError):
        reports.at_positions(square, [1000], "row_id")
    assert reports.of_classes(square, [1]).where("label <> 1").count() == 0


def test_stretches_meet(spark, monkeypatch):
    """Small stretches give what one stretch gives."""
    monkeypatch.setattr(ordered, "SEGMENT", 7)
    from driftloom.operators import windows

    rng = random.Random(3)
    err = [int(rng.random() < 0.3) for _ in range(60)]
    rows = spark.createDataFrame([("a", i, e, "xy"[e]) for i, e in enumerate(err)], "stream_id string, seq long, err int, label string")
    s, path = 0.0, []
    for e in err:
        s = max(0.0, s + e - 0.3)
        path.append(s)
    assert [r.s for r in windows.cusum(rows, 0.2, 0.1).orderBy("seq").collect()] == pytest.approx(path)
    rates = [r.rate for r in windows.sliding_error_rate(rows, 20).orderBy("seq").collect()]
    assert rates == pytest.approx([sum(err[i : i + 20]) / 20 for i in range(41)])
    smooth = [r.smooth for r in windows.median_filter(rows.withColumn("value", F.col("err")), 5).orderBy("seq").collect()]
    padded = [err[0]] * 2 + err + [err[-1]] * 2
    assert smooth == [sorted(padded[i : i + 5])[2] for i in range(60)]
    runs = [(r.label, r.length) for r in windows.runs(rows).orderBy("run").collect()]
    assert runs == [("xy"[k], len(list(g))) for k, g in itertools.groupby(err)]
    labels = rows.select("stream_id", F.col("seq").alias("win"), (F.col("err") * (F.col("seq") % 3) - 1).cast("int").alias("label"))
    real = [(i, e * (i % 3) - 1) for i, e in enumerate(err)]
    kept, want, old = [x for x in real if x[1] != -1], [], None
    for i, x in kept:
        if (old is not None and old != x) or (old is None and real[0][1] == -1):
            want.append(i)
        old = x
    assert [r.win for r in windows.change_points(labels).orderBy("win").collect()] == want


def test_starts(spark):
    err = [0] * 200 + [1] * 60
    rows = spark.createDataFrame([("a", i, e) for i, e in enumerate(err)], "stream_id string, seq long, err int")
    drifts = spark.createDataFrame([("a", 0, 205, 215)], "stream_id string, drift long, warned_at long, detected_at long")
    started = detectors.start_by_gradient(rows, drifts)
    assert started.first().start == 180
    assert detectors.clamped(started, 10).first().start == 205
    ended = detectors.end_rates(rows, started.withColumn("end", F.lit(240).cast("long")), 20)
    assert ended.first().rate_end == 1.0


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def greedy(rows, of, k):
    """Rows of class `of`, each the one that raises the sum of all rows' best likeness most; the first of equal ones."""
    mine, chosen = [r for r in rows if r[1] == of], []
    best = [0.0] * len(mine)
    for _ in range(k):
        gain = {c[0]: round(sum(max(likeness(c[2], r[2]) - b, 0) for r, b in zip(mine, best, strict=True)), 6) for c in mine if c[0] not in chosen}
        pick = min(gain, key=lambda i: (-gain[i], i))
        chosen.append(pick)
        leaves = next(r[2] for r in mine if r[0] == pick)
        best = [max(b, likeness(leaves, r[2])) for r, b in zip(mine, best, strict=True)]
    return chosen


def test_medoids_count_every_row(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.randrange(3) for _ in range(4)]) for i in range(150)]
    frame = spark.createDataFrame(rows, "row_id long, label int, leaves array<int>").repartition(5)
    got = prototypes.select(frame, "kmedoids", 3).collect()
    assert {c: [r.row_id for r in got if r["class"] == c] for c in (0, 1)} == {c: greedy(rows, c, 3) for c in (0, 1)}


def test_accuracy_selector_never_falls(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, [(i % 3) * (rng.random() < 0.7) for _ in range(5)]) for i in range(90)]
    rows = [(i, c, [int(x) for x in leaves]) for i, c, leaves in rows]
    frame = spark.createDataFrame(rows, "row_id long, label int, leaves array<int>")
    chosen = [r.row_id for r in prototypes.select(frame, "accuracy", 5).collect()]

    def right(protos):
        return sum(max(protos, key=lambda p: (likeness(rows[p][2], r[2]), -protos.index(p))) % 3 == r[1] for r in rows)

    scores = [right(chosen[: k + 1]) for k in range(len(chosen))]
    assert scores == sorted(scores) and scores[0] == max(right([i]) for i in range(90))


def test_windows_cluster_as_in_memory(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(3):
        x = np.concatenate([rng.normal(c, 0.2, 8) for c in (0, 4, 9)] + [rng.uniform(-20, 30, 6)])
        d = np.abs(x[:, None] - x[None])
        matrix = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(x)) for j in range(len(x))], "i int, j int, value double")
        got = {r.win: r.label for r in clusters.cluster_windows(matrix).collect()}
        assert [got[i] for i in range(len(x))] == clusters.hdbscan(d).tolist()
        assert len(set(got.values())) >= 3


def test_clamped_windows():
    from driftloom.sources.tables import clamped_windows

    assert clamped_windows(3, 5, 10) == (3, 5) and clamped_windows(-4, 99, 10) == (0, 9) and clamped_windows(9, 2, 10) == (8, 9) and clamped_windows(4, 4, 10) == (4, 5)
    with pytest.raises(ValueError, match="fewer than two"):
        clamped_windows(0, 1, 1)


def test_margin_classifier(spark):
    import random

    from driftloom.operators import boundary, classifiers

    rng = random.Random(3)
    points = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(400)]
    rows = spark.createDataFrame([(x, y, int(x + 2 * y > 0.1)) for x, y in points], "x double, y double, label int")
    model = classifiers.fit(rows, ["x", "y"], preset="svm")
    assert classifiers.accuracy(model, rows).first().accuracy > 0.97
    for r in classifiers.with_classes(model, rows).collect():
        assert abs(sum(r.predicted_p) - 1) < 1e-12 and (r.predicted_p[1] > 0.5) == (r.predicted == 1)
    other = classifiers.fit(rows.withColumn("label", (rows.x > 0).cast("int")), ["x", "y"], preset="svm")
    marked = boundary.disagreement_map(rows, ["x", "y"], model, other, size=20)
    assert 0 < marked.where("differ = 1").count() < 400
