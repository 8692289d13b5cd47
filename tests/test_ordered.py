"""Order operators give the same for groups in one window and for groups cut into stretches, and read their input few times."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.operators import block_stats, ordered, two_sample
from driftloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(k, rng.choice(["u", None]), float(int(rng.gauss(0, 30))), i) for k in ("a", "b", None) for i in range(300)] + [("one", "u", 4.0, 1)]
    return spark.createDataFrame(data, "k string, g string, value double, id long")


@pytest.mark.parametrize("segment, groups", [(65_536, 10_000), (10, 10_000), (10, 1)])
def test_stretches_change_nothing(rows, monkeypatch, segment, groups):
    monkeypatch.setattr(ordered, "SEGMENT", segment)
    monkeypatch.setattr(ordered, "MAX_BROADCAST_GROUPS", groups)
    of = defaultdict(list)
    for r in rows.collect():
        of[r.k, r.g].append((r.value, r.id))
    found = ordered.numbered(rows, ["k", "g"], ["value", "id"], "at").collect()
    assert {(r.k, r.g, r.value, r.id): r["at"] for r in found} == {(*key, v, i): n for key, vs in of.items() for n, (v, i) in enumerate(sorted(vs), 1)}

    ranked = ordered.mid_ranks(rows, ["k", "g"], {"value": "rank"}).collect()
    for r in ranked:
        values = [v for v, _ in of[r.k, r.g]]
        assert r["rank"] == sum(v < r.value for v in values) + (values.count(r.value) + 1) / 2

    cum = ordered.by_value(rows.groupBy("k", "g", "value").agg(F.count("*").alias("n")), ["k", "g"], {"n": "n"}).collect()
    for r in cum:
        values = sorted(v for v, _ in of[r.k, r.g])
        after = [v for v in values if v > r.value]
        assert (r.run_n, r.all_n, r["_next"]) == (sum(v <= r.value for v in values), len(values), after[0] if after else None)

    whole = ordered.quantiles(rows, [], {"m": 0.5}).first().m
    values = sorted(v for vs in of.values() for v, _ in vs)
    assert whole == values[len(values) // 2]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


@pytest.mark.parametrize("name", ["spearman_paired", "block_group_stats", "block_stats_shift", "stats_vote", "ks_two_sample", "wasserstein_two_sample", "anderson_darling_raw", "label_runs", "cusum_path", "quantile_pairs", "box_quartiles", "detector_comparison"])
def test_no_plan_reads_its_input_many_times(spark, name):
    assert scans(QUERIES[name](spark, SF_DIR)) <= 4


def test_empty(rows):
    none = rows.where("false")
    assert ordered.numbered(none, ["k"], ["value"], "at").collect() == []
    assert ordered.quantiles(none, ["k"], {"m": 0.5}).collect() == []
    long = none.select(F.col("k").alias("label"), F.col("g").alias("feature"), F.lit("before").alias("block"), "value", "id")
    assert block_stats.group_stats(long).collect() == [] and two_sample.spearman(long, ["id"]).collect() == []


@pytest.mark.parametrize("listed", [64, 3])
def test_harmonic_sums(spark, listed):
    places = [1, 2, 3, 10, 63, 64, 65, 66, 100, 1000, 20_000]
    h, h2 = two_sample.harmonic(F.col("m").cast("double"), listed)
    for r in spark.createDataFrame([(m,) for m in places], "m long").select("m", h.alias("h"), h2.alias("h2")).collect():
        error = 1e-13 if listed == 64 or r.m >= 64 or r.m <= 3 else 1e-8
        assert abs(r.h - sum(1 / i for i in range(1, r.m + 1))) < error and abs(r.h2 - sum(1 / i**2 for i in range(1, r.m + 1))) < error


def test_closed_form_of_the_double_sum(spark):
    for n in (4, 5, 30, 200):
        double = sum(1 / ((n - i) * j) for i in range(1, n) for j in range(i + 1, n))
        h, h2 = two_sample.harmonic(F.lit(float(n - 1)))
        assert abs(spark.range(1).select((h2 - 2 * h / n).alias("g")).first().g - double) < 1e-12
