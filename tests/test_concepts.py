import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import concepts as cc
from driftloom.operators.ferns import Ferns, leaf_counts, tree_weights
from driftloom.plans.catalog import QUERIES

FERNS = Ferns.random({"x": (0.0, 1.0), "y": (0.0, 1.0)}, trees=6, depth=3, seed=1)


def leaves_of(x, y):
    return [sum((v > cut) << level for level, (f, cut) in enumerate(tree) for v in [x if f == "x" else y]) for tree in FERNS.splits]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for win in range(4):
        for i in range(60):
            x, y = rng.random(), rng.random()
            label = int(x > (0.5 if win < 2 else 0.8)) if rng.random() < 0.95 else 2
            out.append((win, win * 60 + i, label, x, y))
    frame = spark.createDataFrame(out, "win int, row_id long, label int, x double, y double")
    return frame.withColumn("leaves", FERNS.leaves()).withColumn("center", F.array("x", "y")).cache()


def test_learning_adds_up(rows):
    data = rows.collect()
    assert all(r.leaves == leaves_of(r.x, r.y) for r in data)
    found = {(r.win, r.tree, r.leaf, r.label): r.n for r in leaf_counts(rows).collect()}
    for (win, tree, leaf, label), n in found.items():
        assert n == sum(r.win <= win and r.leaves[tree] == leaf and r.label == label for r in data)
    assert {(w, t, f) for w, t, f, _ in found} == {(r.win, t, f) for r in data for t, f in enumerate(r.leaves)}
    for r in tree_weights(leaf_counts(rows)).collect():
        seen = [d for d in data if d.win <= r.win]
        hits = sum(max(sum(d.leaves[r.tree] == f and d.label == c for d in seen) for c in range(3)) for f in {d.leaves[r.tree] for d in seen})
        assert abs(r.weight - hits / len(seen)) < 1e-12


def test_prototypes_are_rows_of_their_window(rows):
    chosen = cc.select_by_window(rows, tree_weights(leaf_counts(rows))).collect()
    of = {r.row_id: r for r in rows.collect()}
    assert all(of[p.proto_id].win == p.win and of[p.proto_id].label == p.label and of[p.proto_id].center == p.center for p in chosen)
    assert {(p.win, p.label) for p in chosen} == {(r.win, r.label) for r in of.values()}
    assert len({(p.win, p.proto_id) for p in chosen}) == len(chosen)


def test_first_choice_is_the_medoid():
    rng = np.random.default_rng(0)
    leaves, labels = rng.integers(0, 3, (40, 5)), rng.integers(0, 2, 40)
    picks = cc.apete(leaves, labels, np.ones(40), np.ones(5))
    best = max((sum(np.mean(leaves[i] == leaves[j]) for j in range(40) if labels[j] == labels[i]), -i) for i in range(40))
    assert abs(sum(np.mean(leaves[picks[0]] == leaves[j]) for j in range(40) if labels[j] == labels[picks[0]]) - best[0]) < 1e-9 or labels[picks[0]] == 0


def nearest(protos, x):
    return min((float(np.linalg.norm(np.subtract(p.center, x))), p.proto_id, p.label) for p in protos)


def test_measures_by_definition(rows):
    protos = cc.select_by_window(rows, tree_weights(leaf_counts(rows)))
    sets, data = {}, rows.collect()
    for p in protos.collect():
        sets.setdefault(p.win, []).append(p)
    pairs = cc.all_pairs(protos)
    agreements = {(r.win_a, r.win_b): r for r in cc.window_agreements(rows, protos, pairs).collect()}
    impacts = {(r.win_a, r.win_b): r.impact for r in cc.window_reassignment(rows, protos, pairs).collect()}
    assert set(agreements) == set(impacts) == {(a, b) for b in range(4) for a in range(b)}
    for (a, b), r in agreements.items():
        mine = [d for d in data if d.win == b]
        us, vs = ([nearest(sets[w], d.center)[1] for d in mine] for w in (a, b))
        n = len(mine)
        same = lambda g: {(i, j) for i in range(n) for j in range(i) if g[i] == g[j]}
        pu, pv, all_ = same(us), same(vs), n * (n - 1) / 2
        expected = len(pu) * len(pv) / all_
        assert abs(r.rand_index - (len(pu & pv) - expected) / ((len(pu) + len(pv)) / 2 - expected)) < 1e-9
        assert abs(r.fowlkes_mallows - len(pu & pv) / (len(pu) * len(pv)) ** 0.5) < 1e-9
        assert -1 <= r.mutual_information <= 1 and 0 <= r.completeness <= 1 + 1e-9

        def accuracy(ps, rows_of=mine):
            return np.mean([nearest(ps, d.center)[2] == d.label for d in rows_of])

        ways = [np.mean([abs(accuracy([*sets[base], p]) - accuracy(sets[base])) for p in sets[extra]]) for base, extra in ((b, a), (a, b))]
        assert abs(impacts[a, b] - sum(ways) / 2) < 1e-9


@pytest.mark.parametrize("sides", [(256, 32), (2, 1)])
def test_all_windows_meet_in_blocks(rows, monkeypatch, sides):
    monkeypatch.setattr(cc, "SIDES", sides)
    protos = cc.select_by_window(rows, tree_weights(leaf_counts(rows)))
    found = cc.window_measures(rows, protos)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan and "Generate explode" in plan  # no row for each row and pair
    given = cc.window_measures(rows, protos, cc.all_pairs(protos)).collect()
    key = lambda r: (r.win_a, r.win_b)
    pairs = zip(sorted(found.collect(), key=key), sorted(given, key=key), strict=True)
    assert len(given) == 6 and all(np.allclose(tuple(a), tuple(b), atol=1e-12) for a, b in pairs)


def test_equal_groupings_agree():
    assert all(abs(v - 1) < 1e-9 for v in cc.indices(np.diag([5, 9, 3])))
    assert abs(cc.indices(np.array([[10, 10], [10, 10]]))[0]) < 0.06


def brute_blocks(values, grace, sigmas, falling):
    out, start = [], 0
    for i, v in enumerate(values):
        at = i - start
        reference = values[start + grace // 2 : start + grace]
        drift = at >= grace and ((np.mean(reference) - v if falling else v - np.mean(reference)) > sigmas * np.std(reference))
        out.append((at, bool(drift)))
        start = i + 1 if drift else start
    return out


@pytest.mark.parametrize("measure", ["centroid_displacement", "rand_index"])
def test_detector_learns_anew(spark, measure):
    rng = random.Random(2)
    values = [rng.random() + (3 if i in (30, 31, 70) else -3 if i in (50, 90) else 0) for i in range(120)]
    frame = spark.createDataFrame([(s, i, v if i else None) for s in "ab" for i, v in enumerate(values)], "stream_id string, win long, value double")
    found = cc.detect_blocks(frame, measure, 10).collect()
    want = brute_blocks(values, 10, 3.0, measure == "rand_index")
    for s in "ab":
        assert [(r.iteration, r.drift) for r in sorted(found, key=lambda r: r.win) if r.stream_id == s] == want
    assert sum(d for _, d in want) >= 2


def test_moving_concept_is_seen(spark):
    rows = sorted(QUERIES["block_detection"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.win)
    moved = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("ts < timestamp_ntz '2024-01-15'").count() // 50
    assert any(r.drift and moved <= r.win <= moved + 1 for r in rows)


def test_windows_far_apart_differ_more(spark):
    rows = QUERIES["selected_window_comparison"](spark, "/root/testdata/sf0.01").collect()
    apart = [r for r in rows if r.win_a < 8 and r.win_b > 11]
    alike = [r for r in rows if r.win_b < 8 or r.win_a > 11]
    mean = lambda rs, c: np.mean([r[c] for r in rs])
    assert mean(apart, "prototype_reassignment_impact") > mean(alike, "prototype_reassignment_impact")
    assert mean(apart, "centroid_displacement") > mean(alike, "centroid_displacement")


def test_contribution_is_the_fall_without_each(spark, rows):
    from driftloom.operators import prototypes

    data = rows.withColumn("predicted", F.col("label")).withColumn("predicted", F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("predicted")))
    protos = rows.where("row_id % 23 = 0").select(F.col("row_id").alias("proto_id"), F.col("label").alias("class"), "leaves")
    all_, sets = [r for r in data.collect() if r.predicted is not None], protos.collect()

    def balanced(ps):
        hits = {}
        for r in all_:
            near = min(ps, key=lambda p: (-sum(x == y for x, y in zip(r.leaves, p.leaves, strict=True)), p.proto_id))
            hits.setdefault(r.predicted, []).append(near["class"] == r.predicted)
        return np.mean([np.mean(h) for h in hits.values()])

    found = {r.proto_id: r.contribution for r in prototypes.contributions(data, protos).collect()}
    assert set(found) == {p.proto_id for p in sets}
    for p in sets:
        assert abs(found[p.proto_id] - (balanced(sets) - balanced([q for q in sets if q is not p]))) < 1e-9
    assert abs(prototypes.mean_contribution(data, protos).first().contribution - np.mean(list(found.values()))) < 1e-9
    one = protos.limit(1)
    assert abs(prototypes.contributions(data, one).first().contribution - balanced(one.collect())) < 1e-9
