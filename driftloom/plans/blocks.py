"""Queries over two blocks of a labelled table: statistics, tests, divergences, scaling and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import encoding
from driftloom.operators import block_stats as bs
from driftloom.operators import two_sample as ts
from driftloom.sources.tables import read, to_long, with_blocks

from .registry import query, rounded

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEMS = """src AS (SELECT l_returnflag AS label, CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'before' ELSE 'after' END AS block,
  l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
long AS (SELECT label, feature, block, value FROM (UNPIVOT src ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))"""
EVENTS = """long AS (SELECT event_type AS label, 'value' AS feature, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS block, value, ts, event_id FROM events)"""
CUMULATIVE = """counts AS (SELECT label, feature, value, sum((block = 'before')::INT) AS c0, sum((block = 'after')::INT) AS c1 FROM long GROUP BY ALL),
cum AS (SELECT *, sum(c0) OVER w AS k0, sum(c1) OVER w AS k1, sum(c0) OVER e AS n0, sum(c1) OVER e AS n1, lead(value) OVER (PARTITION BY label, feature ORDER BY value) AS nxt FROM counts
  WINDOW w AS (PARTITION BY label, feature ORDER BY value ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY label, feature))"""
SCALED = """fit AS (SELECT feature AS f, min(CASE WHEN block = 'before' THEN value END) AS lo, max(CASE WHEN block = 'before' THEN value END) AS hi FROM raw GROUP BY 1),
long AS (SELECT label, feature, block, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS value FROM raw JOIN fit ON feature = f)"""
BINNED = """rng AS (SELECT label, feature, min(value) AS lo, max(value) AS hi FROM long WHERE block = 'before' GROUP BY ALL),
binned AS (SELECT label, feature, block, least(floor((value - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 30), 29)::INT AS bin FROM long JOIN rng USING (label, feature) WHERE value BETWEEN lo AND hi),
hist AS (SELECT r.label, r.feature, b.bin::INT AS bin, CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS width, count(*) FILTER (n.block = 'before') AS c0, count(*) FILTER (n.block = 'after') AS c1
  FROM rng r CROSS JOIN (SELECT unnest(range(30)) AS bin) b LEFT JOIN binned n ON n.label = r.label AND n.feature = r.feature AND n.bin = b.bin GROUP BY ALL),
dens AS (SELECT *, c0 / (sum(c0) OVER e * width / 30) + 1e-10 AS d0, c1 / (sum(c1) OVER e * width / 30) + 1e-10 AS d1, sum(c0) OVER e AS n0, sum(c1) OVER e AS n1 FROM hist WINDOW e AS (PARTITION BY label, feature)),
pq AS (SELECT *, d0 / sum(d0) OVER e AS p, d1 / sum(d1) OVER e AS q FROM dens WINDOW e AS (PARTITION BY label, feature))"""


def items(spark, sf_dir) -> DataFrame:
    rows = with_blocks(read(spark, sf_dir, "lineitem"), F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp_ntz"))
    return to_long(rows.withColumnRenamed("l_returnflag", "label"), ["label", "block"], FEATURES)


def events(spark, sf_dir) -> DataFrame:
    rows = with_blocks(read(spark, sf_dir, "events"), F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return rows.select(F.col("event_type").alias("label"), F.lit("value").alias("feature"), "block", "value", "ts", "event_id")


@query(f"WITH {ITEMS} SELECT label, feature, block, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, median(value) AS median, count(value) AS n FROM long GROUP BY ALL")
def block_group_stats(spark, sf_dir):
    s = bs.group_stats(items(spark, sf_dir))
    return s.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


SHIFTS = """g AS (SELECT label, feature, block, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median FROM long GROUP BY ALL),
gl AS (SELECT label, feature, block, stat, v FROM (UNPIVOT g ON mean, std, min, max, median INTO NAME stat VALUE v)),
sh AS (SELECT label, feature, stat, coalesce(max(v) FILTER (block = 'before'), 0) AS before, coalesce(max(v) FILTER (block = 'after'), 0) AS after FROM gl GROUP BY ALL),
shifts AS (SELECT *, (after - before) / abs(before + 1e-10) AS shift FROM sh)"""


@query(f"WITH {EVENTS}, {SHIFTS} SELECT label, feature, stat, round(before, 6) AS before, round(after, 6) AS after, round(shift, 6) AS shift, shift > 0.2 AS drift FROM shifts")
def block_stats_shift(spark, sf_dir):
    return rounded(bs.stats_shift(events(spark, sf_dir)))


@query(f"WITH {ITEMS}, {SHIFTS}, v AS (SELECT stat, bool_or(shift > 0.2) AS stat_drift FROM shifts GROUP BY 1) SELECT stat, stat_drift, avg(stat_drift::INT) OVER () > 0.4 AS drift FROM v")
def stats_vote(spark, sf_dir):
    return bs.stats_vote(bs.stats_shift(items(spark, sf_dir)))


@query(f"""WITH {EVENTS}, c AS (SELECT label, count(*) FILTER (block = 'before') AS b, count(*) FILTER (block = 'after') AS a FROM long GROUP BY 1),
r AS (SELECT label, b / sum(b) OVER () AS rb, a / sum(a) OVER () AS ra FROM c)
SELECT label, round(rb, 6) AS ratio_before, round(ra, 6) AS ratio_after, round((ra - rb) / abs(rb + 1e-10), 6) AS shift, (ra - rb) / abs(rb + 1e-10) > 0.2 AS drift FROM r""")
def class_ratio_shift(spark, sf_dir):
    return rounded(bs.class_ratio_shift(events(spark, sf_dir)))


ORDER_BLOCKS = "ords AS (SELECT o_orderstatus AS label, CASE WHEN o_orderdate < TIMESTAMP '1998-05-24' THEN 'before' ELSE 'after' END AS block FROM orders)"


@query(f"WITH {ORDER_BLOCKS}, f AS (SELECT avg((label = 'F')::INT) FILTER (block = 'before') AS b, avg((label = 'F')::INT) FILTER (block = 'after') AS a FROM ords) SELECT round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM f")
def class_frequency_change(spark, sf_dir):
    rows = with_blocks(read(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1998-05-24").cast("timestamp_ntz"))
    return rounded(bs.class_frequency(rows.withColumnRenamed("o_orderstatus", "label"), "F"))


@query(f"""WITH {ITEMS}, g AS (SELECT label, feature, block, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY ALL),
w AS (SELECT label, feature, max(median) FILTER (block = 'before') AS median_before, max(median) FILTER (block = 'after') AS median_after, max(mean) FILTER (block = 'before') AS mean_before,
 max(mean) FILTER (block = 'after') AS mean_after, max(std) FILTER (block = 'before') AS std_before, max(std) FILTER (block = 'after') AS std_after FROM g GROUP BY ALL)
SELECT label, feature, round(median_before, 4) AS median_before, round(median_after, 4) AS median_after, round(mean_before, 4) AS mean_before, round(mean_after, 4) AS mean_after, round(std_before, 4) AS std_before, round(std_after, 4) AS std_after,
 round(CASE WHEN median_before <> 0 THEN (median_after - median_before) / median_before * 100 END, 4) AS median_change_pct, round(CASE WHEN mean_before <> 0 THEN (mean_after - mean_before) / mean_before * 100 END, 4) AS mean_change_pct,
 round(CASE WHEN std_before <> 0 THEN (std_after - std_before) / std_before * 100 END, 4) AS std_change_pct FROM w""")
def block_summary(spark, sf_dir):
    return rounded(bs.summary(items(spark, sf_dir)), 4)


KS = "cells AS (SELECT label, feature, max(n0)::BIGINT AS n_before, max(n1)::BIGINT AS n_after, max(abs(k0 / n0 - k1 / n1)) AS stat FROM cum GROUP BY ALL)"


@query(f"""WITH {ITEMS}, {CUMULATIVE}, {KS}, z AS (SELECT *, stat * stat * n_before * n_after / (n_before + n_after) AS z2 FROM cells),
p AS (SELECT *, CASE WHEN z2 < 0.03 THEN 1 ELSE least(greatest((SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * k * k * z2)) FROM (SELECT unnest(range(1, 101)) AS k)), 0), 1) END AS p_value FROM z)
SELECT label, feature, n_before, n_after, round(stat, 6) AS stat, round(p_value, 6) AS p_value, p_value < 0.05 AS drift FROM p""")
def ks_two_sample(spark, sf_dir):
    return rounded(ts.kolmogorov_smirnov(items(spark, sf_dir)))


@query(f"WITH {ITEMS.replace('long AS', 'raw AS')}, {SCALED}, {CUMULATIVE}, d AS (SELECT label, feature, max(n0)::BIGINT AS n_before, max(n1)::BIGINT AS n_after, sum(abs(k0 / n0 - k1 / n1) * (nxt - value)) AS stat FROM cum GROUP BY ALL) SELECT label, feature, n_before, n_after, round(stat, 6) AS stat, stat > 0.1 AS drift FROM d")
def wasserstein_two_sample(spark, sf_dir):
    return rounded(ts.wasserstein(ts.scaled_by_before(items(spark, sf_dir))))


@query(f"WITH {EVENTS}, {BINNED} SELECT label, feature, bin, round(width, 6) AS width, c0, c1 FROM hist")
def histogram_30(spark, sf_dir):
    return rounded(ts.histograms(events(spark, sf_dir)).select("label", "feature", "bin", "width", "c0", "c1"))


@query(f"WITH {ITEMS.replace('long AS', 'raw AS')}, {SCALED}, {BINNED}, d AS (SELECT label, feature, max(n0)::BIGINT AS n_before, max(n1)::BIGINT AS n_after, sum(p * ln(p / q)) AS stat FROM pq GROUP BY ALL) SELECT label, feature, n_before, n_after, round(stat, 6) AS stat, stat > 0.1 AS drift FROM d")
def kl_divergence(spark, sf_dir):
    return rounded(ts.kullback_leibler(ts.scaled_by_before(items(spark, sf_dir))))


@query(f"WITH {ITEMS.replace('long AS', 'raw AS')}, {SCALED}, {BINNED}, d AS (SELECT label, feature, max(n0)::BIGINT AS n_before, max(n1)::BIGINT AS n_after, sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))) AS stat FROM pq GROUP BY ALL) SELECT label, feature, n_before, n_after, round(stat, 6) AS stat, stat > 0.05 AS drift FROM d")
def js_divergence(spark, sf_dir):
    return rounded(ts.jensen_shannon(ts.scaled_by_before(items(spark, sf_dir))))


@query(f"""WITH {EVENTS}, placed AS (SELECT label, feature, block, value, row_number() OVER (PARTITION BY label, feature, block ORDER BY ts, event_id) AS k FROM long),
pairs AS (SELECT a.label, a.feature, a.k, a.value AS x, b.value AS y FROM placed a JOIN placed b ON a.label = b.label AND a.feature = b.feature AND a.k = b.k AND a.block = 'before' AND b.block = 'after'),
ranked AS (SELECT label, feature, rank() OVER (PARTITION BY label, feature ORDER BY x) + (count(*) OVER (PARTITION BY label, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY label, feature ORDER BY y) + (count(*) OVER (PARTITION BY label, feature, y) - 1) / 2 AS ry FROM pairs)
SELECT label, feature, count(*) AS n, round(corr(rx, ry), 6) AS stat, abs(corr(rx, ry)) < 0.9 AS drift FROM ranked GROUP BY ALL""")
def spearman_paired(spark, sf_dir):
    return rounded(ts.spearman(events(spark, sf_dir), ["ts", "event_id"]))


@query(f"""WITH {EVENTS}, {CUMULATIVE}, t AS (SELECT *, c0 + c1 AS l, n0 + n1 AS n, k0 + k1 - (c0 + c1) / 2 AS b, k0 - c0 / 2 AS m0, k1 - c1 / 2 AS m1 FROM cum)
SELECT label, feature, round((max(n) - 1) / max(n) * sum(l / n * ((n * m0 - b * n0) ** 2 / n0 + (n * m1 - b * n1) ** 2 / n1) / nullif(b * (n - b) - n * l / 4, 0)), 6) AS a2 FROM t GROUP BY ALL""")
def anderson_darling_raw(spark, sf_dir):
    return rounded(ts.anderson_darling(events(spark, sf_dir)).select("label", "feature", "a2"))


#: log p as a quadratic of the critical values, by DuckDB's own normal equations.
AD_FIT = f"""crit AS (SELECT unnest({list(ts.AD_CRITICAL)}::DOUBLE[]) AS x, ln(unnest({list(ts.AD_LEVELS)}::DOUBLE[])) AS y), sm AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM crit),
det AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS dt FROM sm), coef AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / dt AS q0,
 (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / dt AS q1, (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / dt AS q2 FROM det)"""


@query(f"""WITH {ITEMS}, {CUMULATIVE}, t AS (SELECT *, c0 + c1 AS l, n0 + n1 AS n, k0 + k1 - (c0 + c1) / 2 AS b, k0 - c0 / 2 AS m0, k1 - c1 / 2 AS m1 FROM cum),
a AS (SELECT label, feature, max(n0)::BIGINT AS n_before, max(n1)::BIGINT AS n_after, (max(n) - 1) / max(n) * sum(l / n * ((n * m0 - b * n0) ** 2 / nullif(n0, 0) + (n * m1 - b * n1) ** 2 / nullif(n1, 0)) / nullif(b * (n - b) - n * l / 4, 0)) AS a2 FROM t GROUP BY ALL),
ns AS (SELECT DISTINCT n_before + n_after AS n FROM a), hs AS (SELECT n, sum(1 / i) AS h, sum(1 / i * (1 / i)) AS h2 FROM ns, range(1, n) r(i) GROUP BY 1),
v AS (SELECT a.*, hs.n::DOUBLE AS n, 1 / nullif(n_before, 0) + 1 / nullif(n_after, 0) AS hh, h, h2 - 2 * h / hs.n AS g FROM a JOIN hs ON hs.n = n_before + n_after),
s AS (SELECT *, (a2 - 1) / sqrt((((4 * g - 6) + (10 - 6 * g) * hh) * n ** 3 + ((2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * hh - 8 * h + 4 * g - 6) * n ** 2 + ((6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * hh + 4 * h) * n + (2 * h + 6) * 4 - 8 * h) / ((n - 1) * (n - 2) * (n - 3))) AS stat FROM v), {AD_FIT},
p AS (SELECT s.*, greatest(least(CASE WHEN stat <= 0.325 THEN 0.25 WHEN stat >= 6.546 THEN 0.001 ELSE exp(q0 + q1 * stat + q2 * stat * stat) END, 0.25), 0.001) AS p_value FROM s, coef)
SELECT label, feature, n_before, n_after, round(a2, 6) AS a2, CASE WHEN n_before > 0 AND n_after > 0 THEN round(stat, 6) END AS stat, round(p_value, 6) AS p_value, CASE WHEN n_before = 0 OR n_after = 0 THEN true ELSE coalesce(p_value < 0.05, false) END AS drift FROM p""")
def anderson_darling_test(spark, sf_dir):
    return rounded(ts.anderson_darling(items(spark, sf_dir)))


@query(f"""WITH {ITEMS.replace('long AS', 'raw AS')}, {SCALED}, {CUMULATIVE}, {BINNED},
w AS (SELECT 'wasserstein' AS test, sum(abs(k0 / n0 - k1 / n1) * (nxt - value)) > 0.1 AS drift FROM cum GROUP BY label, feature),
kl AS (SELECT 'kl' AS test, sum(p * ln(p / q)) > 0.1 AS drift FROM pq GROUP BY label, feature),
js AS (SELECT 'js' AS test, sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))) > 0.05 AS drift FROM pq GROUP BY label, feature),
v AS (SELECT test, avg(drift::INT) > 0.2 AS test_drift FROM (SELECT * FROM w UNION ALL SELECT * FROM kl UNION ALL SELECT * FROM js) GROUP BY 1)
SELECT test, test_drift, avg(test_drift::INT) OVER () > 0.4 AS drift FROM v""")
def test_vote(spark, sf_dir):
    return ts.vote(ts.run_all(items(spark, sf_dir), [], ["kl", "wasserstein", "js"]))


@query(f"WITH {EVENTS}, {CUMULATIVE} SELECT label, feature, value, round(k0 / n0, 6) AS before, round(k1 / n1, 6) AS after FROM cum")
def ecdf(spark, sf_dir):
    e = ts.ecdf(events(spark, sf_dir))
    return e.withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query(f"WITH {EVENTS} SELECT label, feature, block, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM long GROUP BY ALL")
def box_quartiles(spark, sf_dir):
    q = ts.quartiles(events(spark, sf_dir))
    return q.withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@query(f"""WITH {EVENTS}, s AS (SELECT label, block, stddev_samp(value) * power(count(*), -0.2) AS h, count(*) AS n FROM long GROUP BY ALL),
j AS (SELECT label, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1), v AS (SELECT label, block, value, count(*) AS c FROM long GROUP BY ALL)
SELECT v.label, 'value' AS feature, v.block, round(lo + i * (hi - lo) / 49, 6) AS x, round(sum(c * exp(-0.5 * ((lo + i * (hi - lo) / 49 - value) / h) ** 2)) / max(n * h) / sqrt(2 * pi()), 6) AS density
FROM v JOIN s ON v.label = s.label AND v.block = s.block JOIN j ON v.label = j.label CROSS JOIN (SELECT unnest(range(50)) AS i) GROUP BY v.label, v.block, i, lo, hi""")
def kernel_density(spark, sf_dir):
    return rounded(ts.kernel_density(events(spark, sf_dir), 50))


STATS_OF = "SELECT label, feature, block, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM long GROUP BY ALL"


def _spread(long):
    return rounded(long.groupBy("label", "feature", "block").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")))


@query(f"WITH {ITEMS.replace('long AS', 'raw AS')}, {SCALED} {STATS_OF}")
def minmax_scaled_block(spark, sf_dir):
    return _spread(ts.scaled_by_before(items(spark, sf_dir)))


@query(f"""WITH {ITEMS.replace('long AS', 'raw AS')}, fit AS (SELECT feature AS f, avg(value) FILTER (block = 'before') AS mu, stddev_pop(value) FILTER (block = 'before') AS sd FROM raw GROUP BY 1),
long AS (SELECT label, feature, block, (value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS value FROM raw JOIN fit ON feature = f) {STATS_OF}""")
def standardised_block(spark, sf_dir):
    return _spread(ts.standardised_by_before(items(spark, sf_dir)))


@query("""WITH v AS (SELECT DISTINCT p_brand FROM part), known AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM v WHERE p_brand < 'Brand#4')
SELECT p_partkey, coalesce(code, -1)::INT AS brand_code FROM part LEFT JOIN known USING (p_brand)""")
def ordinal_encode(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    codes = encoding.ordinal_codes(part.where("p_brand < 'Brand#4'"), "p_brand")
    return encoding.ordinal_encode(part, codes, "p_brand", "brand_code").select("p_partkey", "brand_code")


@query("""SELECT o_orderkey, (o_orderstatus = 'F')::INT AS status_F, (o_orderstatus = 'O')::INT AS status_O, (o_orderstatus = 'P')::INT AS status_P FROM orders""")
def one_hot(spark, sf_dir):
    return encoding.one_hot(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"], "status").select("o_orderkey", "status_F", "status_O", "status_P")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest((l_returnflag = 'A')::INT, (l_linestatus = 'A')::INT) AS flag_A, greatest((l_returnflag = 'F')::INT, (l_linestatus = 'F')::INT) AS flag_F,
greatest((l_returnflag = 'N')::INT, (l_linestatus = 'N')::INT) AS flag_N FROM lineitem""")
def multilabel_onehot(spark, sf_dir):
    rows = encoding.multi_one_hot(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["A", "F", "N"], "flag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag_A", "flag_F", "flag_N")


@query("""WITH f AS (SELECT event_type AS label, (value > 50)::INT AS x FROM events), p AS (SELECT label, count(*) AS n, avg(x) AS p FROM f GROUP BY 1),
h AS (SELECT label, n / sum(n) OVER () AS w, CASE WHEN p > 0 AND p < 1 THEN -p * ln(p) - (1 - p) * ln(1 - p) ELSE 0 END AS h FROM p)
SELECT 'over_50' AS feature, round((1 - sum(w * h)) / ln(count(*)), 6) AS weight FROM h""")
def binary_entropy_weight(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), (F.col("value") > 50).cast("int").alias("over_50"))
    return rounded(encoding.binary_entropy_weight(rows, ["over_50"]))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linear_unscale_fit(spark, sf_dir):
    return rounded(encoding.unscale_line(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 4)


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS industrial FROM customer""")
def recoded_customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", encoding.in_ranges("c_acctbal", [(0, "negative"), (5000, "low")], "high").alias("balance"), encoding.in_set("c_mktsegment", ["BUILDING", "MACHINERY"]).alias("industrial"))


@query("""WITH f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal, (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INT AS "c_mktsegment_FURNITURE",
 (c_mktsegment = 'HOUSEHOLD')::INT AS "c_mktsegment_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::INT AS "c_mktsegment_MACHINERY" FROM customer, f""")
def transformed_customers(spark, sf_dir):
    """Balances by mean and deviation, segments as columns of all but the first."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return rounded(encoding.ColumnTransformer.fit(rows, ["c_acctbal"], ["c_mktsegment"]).transform(rows))
