"""Operators against small cases worked out by hand, and against properties of their definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import encoding, text
from driftloom.operators import block_stats, boundary, clusters, detectors, importance, prototypes, recurrence, reduce, two_sample, windows
from driftloom.sources import files, tables


def long_rows(spark, before, after, label="c"):
    rows = [(label, "x", b, float(v), i) for b, values in (("before", before), ("after", after)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "label string, feature string, block string, value double, at int")


def one(df, column="stat"):
    return df.first()[column]


def test_equal_blocks_have_no_distance(spark):
    rows = long_rows(spark, [1, 2, 2, 5, 9], [1, 2, 2, 5, 9])
    for test in (two_sample.kolmogorov_smirnov, two_sample.wasserstein, two_sample.kullback_leibler, two_sample.jensen_shannon):
        r = test(rows).first()
        assert abs(r.stat) < 1e-9 and not r.drift
    assert abs(one(two_sample.spearman(rows, ["at"])) - 1) < 1e-12
    assert block_stats.stats_shift(rows).where("drift or abs(shift) > 1e-9").count() == 0


def test_shifted_block(spark):
    rows = long_rows(spark, range(4), range(1, 5))
    assert one(two_sample.wasserstein(rows)) == pytest.approx(1)
    assert one(two_sample.kolmogorov_smirnov(rows)) == pytest.approx(0.25)
    mean = block_stats.stats_shift(rows).where("stat = 'mean'").first()
    assert mean["shift"] == pytest.approx(1 / 1.5) and mean.drift


def test_class_in_one_block_only(spark):
    rows = long_rows(spark, [], [1, 2, 3])
    for test in (two_sample.kolmogorov_smirnov, two_sample.wasserstein):
        r = test(rows).first()
        assert r.stat is None and r.drift


def test_p_values(spark):
    # published points of the Kolmogorov distribution: Q(1.36) is about 0.049, Q(1.63) about 0.0098
    n = 10_000.0
    for z, p in ((1.36, 0.0494), (1.63, 0.0098), (0.5, 0.9639)):
        d = z / math.sqrt(n * n / (2 * n))
        got = spark.range(1).select(two_sample.ks_p_value(F.lit(d), F.lit(n), F.lit(n))).first()[0]
        assert got == pytest.approx(p, abs=5e-4)
    for stat, p in zip(two_sample.AD_CRITICAL, two_sample.AD_LEVELS, strict=True):
        assert spark.range(1).select(two_sample.ad_p_value(F.lit(stat))).first()[0] == pytest.approx(p, rel=0.15)


def test_anderson_darling_normalisation(spark):
    rows = long_rows(spark, [1, 2, 3, 4, 5, 6], [4, 5, 6, 7, 8, 9])
    got = two_sample.anderson_darling(rows).first()
    n = 12
    h, g = sum(1 / i for i in range(1, n)), sum(1 / ((n - i) * j) for i in range(1, n - 1) for j in range(i + 1, n))
    big = 1 / 6 + 1 / 6
    a, b = (4 * g - 6) + (10 - 6 * g) * big, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * big - 8 * h + 4 * g - 6
    c, d = (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * big + 4 * h, (2 * h + 6) * 4 - 8 * h
    sigma = math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3)))
    assert got.stat == pytest.approx((got.a2 - 1) / sigma)


def test_repair_and_change_points(spark):
    frame = lambda labels: spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "stream_id string, win int, label int")
    fixed = windows.repair_outliers(frame([0, 0, -1, 0, 1, 1]))
    assert [r.label for r in fixed.orderBy("win").collect()] == [0, 0, 0, 0, 1, 1]
    assert [r.win for r in windows.change_points(fixed).collect()] == [4]
    assert [r.win for r in windows.change_points(frame([-1, -1, 2, 2])).collect()] == [2]


def test_cusum_by_hand(spark):
    rows = spark.createDataFrame([("s", i, int(i >= 100)) for i in range(150)], "stream_id string, seq long, err int")
    path = {r.seq: r.s for r in windows.cusum(rows, 0.0, 0.1).collect()}
    assert path[99] == pytest.approx(0) and path[100] == pytest.approx(0.9) and path[101] == pytest.approx(1.8)
    assert windows.cusum_crossing(rows, 0.0).first().start == 101


def test_median_filters(spark):
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 9, 1])], "stream_id string, seq long, value double")
    assert [r.smooth for r in windows.median_filter(rows, 3).orderBy("seq").collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        windows.median_filter(rows, 2)


def test_sequence_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.floor(F.col("id") * 7919 % 1000 / 90).alias("bucket"))
    got = tables.with_sequence(rows, ["k"], F.col("bucket"))
    assert got.where("k <> seq").count() == 0 and got.count() == 1000
    assert tables.row_windows(got, 300).agg(F.max("win")).first()[0] == 2
    assert tables.block_of_size(got, 100, 5000).agg(F.min("seq")).first()[0] == 900
    with pytest.raises(ValueError):
        tables.slice_rows(got, 950, 100)


def test_sweep_separates_two_concepts(spark):
    pairs = [(i, j, float(i % 2 != j % 2)) for i in range(8) for j in range(i + 1, 8)]
    d = spark.createDataFrame(pairs, "win_a int, win_b int, distance double")
    concepts = spark.createDataFrame([(i, i % 2) for i in range(8)], "win int, concept int")
    rows = recurrence.threshold_sweep(d, concepts).collect()
    assert all(r.f1 == 1 for r in rows if 0 < r.threshold < 1)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = map(int, rng.integers(1, 5, 2))
        cost = rng.random((n, m))
        pairs = clusters.assignment(cost)
        k = min(n, m)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(k)) for p in itertools.permutations(range(max(n, m)), k))
        assert len(pairs) == k and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_xmeans_and_hdbscan_find_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (3, 0), (0, 3), (3, 3))])
    assert len(clusters.xmeans(x)) == 4
    y = np.array([0, 0.1, 0.2, 0.15, 5, 5.1, 5.2, 5.05, 20])
    labels = clusters.hdbscan(np.abs(y[:, None] - y[None]))
    assert len(set(labels[:4])) == 1 and len(set(labels[4:8])) == 1 and labels[0] != labels[4] and labels[8] == -1


def test_cluster_drift_end_to_end(spark):
    rng = np.random.default_rng(2)
    rows = [(k, b, *(rng.normal(c, 0.1) + (2.5 if b == "after" and k == 1 else 0) for c in (0, k))) for k in (0, 1) for b in ("before", "after") for _ in range(150)]
    got = {r.label: r for r in clusters.detect(spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "label int, block string, x double, y double"), ["x", "y"], k_max=3).collect()}
    assert got[1].drift and got[1].strength > got[0].strength and 0 <= got[0].strength <= 1
    with pytest.raises(ValueError):
        clusters.Thresholds(match=0.1)


def test_detectors_find_a_planted_drift(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, int(rng.random() < (0.1 if i < 2000 else 0.6))) for i in range(3000)]
    errors = spark.createDataFrame(rows, "stream_id string, seq long, err int")
    for name in set(detectors.DETECTORS) - {"eddm"}:
        found = [r.detected_at for r in detectors.detect(errors, name).collect()]
        assert any(2000 <= f <= 2200 for f in found) and len(found) <= 4, (name, found)
    found = detectors.detect(errors, "fhddm")
    for start in (detectors.start_by_cusum, detectors.start_by_threshold):
        for end in (detectors.end_by_peak, detectors.end_by_recovery):
            r = detectors.describe(errors, end(errors, start(errors, found))).first()
            assert r.start <= r.detected_at <= r["end"] and 0 <= r.rate_peak <= 1
    with pytest.raises(ValueError):
        detectors.detect(errors, "nothing")


def test_prototypes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, *map(float, rng.normal(i % 2 * 2, 0.4, 2))) for i in range(200)]
    frame = spark.createDataFrame(rows, "row_id long, label int, x double, y double")
    leafed = prototypes.with_leaves(prototypes.fit_forest(frame, ["x", "y"], trees=8), frame, ["x", "y"]).persist()
    for method in ("kmedoids", "total", "weighted", "accuracy", "apete"):
        chosen = prototypes.select(leafed, method, 4).withColumnRenamed("row_id", "proto_id")
        assert {r["class"] for r in chosen.collect()} == {0, 1}
        protos = chosen.join(leafed.select(F.col("row_id").alias("proto_id"), "leaves"), "proto_id")
        quality = prototypes.group_metrics(prototypes.assign(leafed, protos)).first()
        assert quality.accuracy > 0.9 and 0 <= quality.hubness_entropy <= 1.0001
    assert prototypes.reassignment_impact(leafed, protos, protos).first().impact == pytest.approx(0, abs=1e-9)
    assert prototypes.kmeans_prototypes(frame, ["x", "y"]).groupBy("class").count().where("count = 3").count() == 2


def test_importance_ranks_the_feature_that_matters(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a > 0), "before" if i < 200 else "after") for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    frame = spark.createDataFrame(rows, "x double, y double, label int, block string")
    model = importance.fit(frame, ["x", "y"], trees=8)
    for method, options in (("permutation", {"repeats": 3}), ("shap", {"background": 10, "sample": 20}), ("lime", {"n_rows": 10, "perturbations": 60})):
        got = {r.feature: r.importance for r in importance.importance(method, model, frame.drop("block"), ["x", "y"], **options).collect()}
        assert got["x"] > 3 * abs(got["y"]), method
    with pytest.raises(ValueError):
        importance.importance("nothing", model, frame, ["x"])


def test_boundary_rules_cover_the_disagreement(spark):
    rng = np.random.default_rng(6)
    points = rng.uniform(-1, 1, (800, 2))
    rows = [(float(x), float(y), int(x > (0 if i < 400 else 0.5)), "before" if i < 400 else "after") for i, (x, y) in enumerate(points)]
    frame = spark.createDataFrame(rows, "x double, y double, label int, block string")
    models = [boundary.classifier(frame.where(F.col("block") == b), ["x", "y"], trees=5, depth=3) for b in ("before", "after")]
    marked = boundary.disagreement_map(frame, ["x", "y"], *models, size=30)
    rules, placed = boundary.drift_rules(marked, ["x", "y"])
    total = rules.agg(F.sum("coverage")).first()[0]
    assert 0.8 <= total <= 1 and placed.count() == 900
    same, _ = boundary.drift_rules(marked.withColumn("differ", F.lit(0)), ["x", "y"])
    assert same.count() == 0


def test_encodings(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "v string")
    codes = encoding.ordinal_codes(rows.where("v < 'c'"), "v")
    assert sorted(r.code for r in encoding.ordinal_encode(rows, codes, "v", "code").collect()) == [-1, -1, 0, 1]
    assert encoding.drop_constant(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), ["a", "b"]).columns == ["b"]
    kinds = spark.createDataFrame([("1",), ("1.5",), ("x",)], "t string").select(encoding.typed("t").alias("k")).collect()
    assert [r.k for r in kinds] == ["long", "double", "string"]


def test_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,y\n1,2,0\n3,?,1\n")
    df = files.read_csv(spark, str(tmp_path / "d.csv"), "y", ["a", "b", "missing"], "?")
    assert df.columns == ["a", "b", "target"] and df.where("b is null").count() == 1
    assert files.preview(spark, str(tmp_path / "d.csv")) == (["a", "b", "y"], "y")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "d.csv"), "none")
    (tmp_path / "d.arff").write_text("@relation r\n% note\n@attribute n numeric\n@attribute 'k w' {a,b}\n@attribute class {0,1}\n@data\n1.5,a,0\n?,b,1\n")
    arff = files.read_arff(spark, str(tmp_path / "d.arff"), recode={"k w": {"a": 0, "b": 1}}).collect()
    assert [tuple(r) for r in arff] == [(1.5, 0.0, "0"), (None, 1.0, "1")]
    split = files.stratified_split(spark.range(100).select("id", (F.col("id") % 2).alias("y")), "y")
    assert {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()} == {(y, s): n for y in (0, 1) for s, n in (("train", 30), ("valid", 10), ("test", 10))}
    with pytest.raises(ValueError):
        files.stratified_split(spark.range(3).withColumn("y", F.lit(0)), "y", (0.5, 0.2, 0.2))


def test_adjusted_mutual_information(spark):
    frame = lambda pairs: recurrence.contingency(spark.createDataFrame(pairs, "u int, v int"))
    ami = lambda pairs: recurrence.adjusted_mutual_information(frame(pairs)).first()[0]
    same = [(i % 3, (i % 3 + 1) % 3) for i in range(30)]
    assert ami(same) == pytest.approx(1)
    rng = np.random.default_rng(7)
    assert abs(ami([tuple(map(int, rng.integers(0, 3, 2))) for _ in range(400)])) < 0.05
    u, v = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1]
    mi = lambda v: sum(
        c / 6 * math.log(6 * c / (u.count(a) * v.count(b))) for a in (0, 1) for b in (0, 1) if (c := sum(x == a and y == b for x, y in zip(u, v, strict=True)))
    )
    chance = np.mean([mi(list(p)) for p in itertools.permutations(v)])
    entropy = lambda x: -sum(x.count(k) / 6 * math.log(x.count(k) / 6) for k in set(x))
    assert ami(list(zip(u, v, strict=True))) == pytest.approx((mi(v) - chance) / ((entropy(u) + entropy(v)) / 2 - chance))


def test_projections(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 2, float(a * 3), float(b * 0.2 + i % 2), float(c * 0.1)) for i, (a, b, c) in enumerate(rng.normal(0, 1, (300, 3)))]
    frame = spark.createDataFrame(rows, "label int, x double, y double, z double")
    assert abs(reduce.pca(frame, ["x", "y", "z"]).axes[0][0]) > 0.99
    assert abs(reduce.lda(frame, ["x", "y", "z"]).axes[0][1]) > 0.95
    assert reduce.pca(frame, ["x", "y", "z"]).transform(frame).agg(F.abs(F.avg("z1"))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        reduce.lda(frame, ["x", "y"], 2)


def test_tfidf(spark):
    docs = spark.createDataFrame([("a b a",), ("a c",), (None,)], "text string")
    rows = text.tfidf(text.fit_tfidf(docs.dropna()), docs).collect()
    assert len(rows) == 3 and len(rows[0].features) == 3 and rows[2].features.numNonzeros() == 0


def test_choices_of_all_classes_take_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 6)), [int(v) for v in rng.integers(0, 3, 4)]) for i in range(240)]
    leafed = spark.createDataFrame(rows, "row_id long, label int, leaves array<int>")
    passes, gains = [], prototypes._Greedy.gains
    monkeypatch.setattr(prototypes._Greedy, "gains", lambda self, *args: passes.append(1) or gains(self, *args))
    picks = prototypes.select(leafed, "total", 12).collect()
    assert len(picks) == 12 and len(passes) <= 1 + max(sum(r["class"] == c for r in picks) for c in range(6))
