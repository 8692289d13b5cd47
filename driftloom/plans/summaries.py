"""Queries of report tables: totals, listings, matched labels, neighbours, histograms, comparisons of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import clusters, reports
from driftloom.sources.scratch import materialize
from driftloom.sources.tables import event_stream, read, row_windows

from .blocks import EVENTS, ITEMS, SHIFTS, events, items
from .models import FEATURES, SIGMA, _fixed
from .registry import query, rounded
from .streams import DIST, WIN, labelled_windows, vectors

FIRSTS = f"{WIN}, pr AS (SELECT win, label, value FROM (SELECT *, row_number() OVER (PARTITION BY win, label ORDER BY seq) AS k FROM (SELECT (seq // 1000)::INT AS win, event_type AS label, value, seq FROM ev WHERE seq // 1000 < (SELECT count(*) // 1000 FROM events))) WHERE k <= 2)"


def window_prototypes(spark, sf_dir):
    """The first two rows of each class in each window."""
    rows = row_windows(event_stream(spark, sf_dir), 1000).select("win", F.col("event_type").alias("label"), "value", "seq")
    keyed = rows.withColumn("_key", F.struct("win", "label"))
    first = reports.first_of_each(keyed, "_key", "seq", 2)
    return materialize(first.select("win", "label", F.col("seq").alias("proto_id"), F.array("value").alias("center")), "first-rows")


@query(f"""WITH {FIRSTS}, n AS (SELECT win, count(*) AS rows FROM w GROUP BY 1), c AS (SELECT n.win, rows, coalesce(k, 0) AS k FROM n LEFT JOIN (SELECT win, count(*) AS k FROM pr GROUP BY 1) USING (win))
SELECT sum(rows)::BIGINT AS samples, sum(k)::BIGINT AS prototypes, round(avg(k), 6) AS avg_per_window, min(k) AS min_per_window, max(k) AS max_per_window, round(stddev_pop(k), 6) AS std_per_window, round(100 * (1 - sum(k) / sum(rows)), 6) AS compression FROM c""")
def stream_totals(spark, sf_dir):
    return rounded(reports.stream_totals(labelled_windows(spark, sf_dir), window_prototypes(spark, sf_dir)))


@query("""SELECT label, (k - 1)::INT AS feature, round(avg(embedding[k]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[k]::DOUBLE), 6) AS std, round(min(embedding[k]::DOUBLE), 6) AS min, round(max(embedding[k]::DOUBLE), 6) AS max
FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY label, k""")
def prototype_feature_stats(spark, sf_dir):
    return rounded(reports.vector_stats(vectors(spark, sf_dir), ["label"]))


@query(f"""WITH {FIRSTS}, wins AS (SELECT DISTINCT win FROM pr), p AS (SELECT a.win AS win_a, b.win AS win_b FROM wins a JOIN wins b ON a.win < b.win), c AS (SELECT win, label, count(*) AS n FROM pr GROUP BY ALL),
k AS (SELECT DISTINCT win_a, win_b, label FROM p JOIN c ON c.win = win_a OR c.win = win_b), z AS (SELECT k.*, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM k LEFT JOIN c x ON x.win = win_a AND x.label = k.label LEFT JOIN c y ON y.win = win_b AND y.label = k.label),
d AS (SELECT z.*, abs(x.value - y.value) AS d, x.rowid AS xi, y.rowid AS yi FROM z JOIN (SELECT *, row_number() OVER () AS rowid FROM pr) x ON x.win = win_a AND x.label = z.label JOIN (SELECT *, row_number() OVER () AS rowid FROM pr) y ON y.win = win_b AND y.label = z.label),
m AS (SELECT win_a, win_b, label, avg(d) AS d FROM (SELECT win_a, win_b, label, CASE WHEN na <= nb THEN xi ELSE yi END AS i, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL)
SELECT z.win_a, z.win_b, round(avg(coalesce(m.d, 0) + 2.0::DOUBLE * abs(na - nb)), 6) AS distance FROM z LEFT JOIN m ON m.win_a = z.win_a AND m.win_b = z.win_b AND m.label = z.label GROUP BY ALL""")
def window_minimal_distances(spark, sf_dir):
    return rounded(reports.compare_windows(window_prototypes(spark, sf_dir), "minimal_distance"))


@query(f"WITH {DIST} SELECT win_a, win_b, round(distance, 6) AS distance FROM dist WHERE win_a = 0 OR win_b = 0")
def window_to_all_displacement(spark, sf_dir):
    rows = labelled_windows(spark, sf_dir).select("win", "label", F.array("value").alias("center"))
    return rounded(reports.compare_windows(rows, "centroid_displacement", 0))


@query(f"""WITH {EVENTS}, r AS (SELECT label, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1), b AS (SELECT l.label, block, lo, (hi - lo) / 30 AS width, least(floor((value - lo) / ((hi - lo) / 30)), 29)::INT AS bin FROM long l JOIN r USING (label)),
c AS (SELECT label, block, bin, count(*) AS n, max(lo) AS lo, max(width) AS width FROM b GROUP BY ALL)
SELECT label, 'value' AS feature, block, bin, round(lo + bin * width, 6) AS left, round(n / sum(n) OVER (PARTITION BY label, block) / width, 6) AS density FROM c""")
def joint_histogram(spark, sf_dir):
    return rounded(reports.joint_histogram(events(spark, sf_dir)))


@query(f"""WITH {ITEMS}, s AS (SELECT *, row_number() OVER (PARTITION BY label, feature, block ORDER BY value) AS k, count(*) OVER (PARTITION BY label, feature, block) AS n FROM long),
q AS (SELECT label, feature, block, i, min(value) AS v FROM s, (SELECT unnest(range(100)) AS i) WHERE k / n >= (i + 0.5::DOUBLE) / 100 GROUP BY ALL)
SELECT label, feature, i, max(v) FILTER (block = 'before') AS before, max(v) FILTER (block = 'after') AS after FROM q GROUP BY ALL""")
def quantile_pairs(spark, sf_dir):
    return reports.quantile_pairs(items(spark, sf_dir))


@query(f"WITH {EVENTS}, {SHIFTS} SELECT label, feature, stat, round(shift, 6) AS shift, row_number() OVER (PARTITION BY stat ORDER BY round(abs(shift), 6) DESC, label)::INT AS place FROM shifts")
def shift_ranking(spark, sf_dir):
    from driftloom.operators import block_stats as bs

    shifts = bs.stats_shift(events(spark, sf_dir)).withColumn("size", F.round(F.abs("shift"), 6))
    return rounded(reports.ranking(shifts, "size", ["label"], ["stat"]).select("label", "feature", "stat", "shift", "place"))


@query(f"""WITH {SIGMA}, u AS (SELECT label, cluster, block, feature, value FROM (UNPIVOT near ON quantity, discount INTO NAME feature VALUE value))
SELECT label, cluster, feature, coalesce(printf('%.4f', avg(value) FILTER (block = 'before')), '-') AS before, coalesce(printf('%.4f', avg(value) FILTER (block = 'after')), '-') AS after FROM u GROUP BY ALL""")
def centroid_listing(spark, sf_dir):
    return reports.centroid_listing(_fixed(spark, sf_dir), FEATURES)


@query(f"""WITH {SIGMA}, m AS (SELECT label, cluster, avg(d) FILTER (block = 'before') AS b, avg(d) FILTER (block = 'after') AS a FROM near GROUP BY ALL)
SELECT label, cluster, coalesce(CASE WHEN (a - b) / b > 0 THEN '+' ELSE '' END || printf('%.2f%%', 100 * (a - b) / b), 'N/A') AS change, coalesce(abs((a - b) / b) > 0.2, true) AS drift FROM m""")
def average_distance_report(spark, sf_dir):
    return reports.distance_report(clusters.mean_distance_shift(_fixed(spark, sf_dir)))


@query(f"""WITH {SIGMA}, u AS (SELECT label, cluster, block, feature, value FROM (UNPIVOT near ON quantity, discount INTO NAME feature VALUE value)),
g AS (SELECT label, cluster, feature, avg(value) FILTER (block = 'before') AS b, avg(value) FILTER (block = 'after') AS a FROM u GROUP BY ALL), s AS (SELECT label, cluster, feature, coalesce(printf('%.2f%%', 100 * (a - b) / CASE WHEN abs(b) < 1e-10 THEN 1 ELSE abs(b) END), 'N/A') AS t FROM g)
SELECT label, cluster, coalesce(max(t) FILTER (feature = 'discount'), 'N/A') AS "discount | mean", coalesce(max(t) FILTER (feature = 'quantity'), 'N/A') AS "quantity | mean" FROM s GROUP BY ALL""")
def stat_shift_report(spark, sf_dir):
    return reports.stat_shift_table(clusters.cluster_stats(_fixed(spark, sf_dir), FEATURES).where("stat = 'mean'"))


@query(f"""WITH {SIGMA}, m AS (SELECT label, cluster, avg(d) FILTER (block = 'before') AS b, avg(d) FILTER (block = 'after') AS a FROM near GROUP BY ALL), x AS (SELECT label, coalesce(abs((a - b) / b) > 0.05, true) AS drift FROM m), y AS (SELECT label, a IS NULL OR b IS NULL AS drift FROM m)
SELECT label, 'distance' AS criterion, sum(drift::INT)::BIGINT AS drifting, count(*) AS items, round(sum(drift::INT) / count(*) * 0.5::DOUBLE / 2, 6) AS contribution FROM x GROUP BY 1
UNION ALL SELECT label, 'count', sum(drift::INT)::BIGINT, count(*), round(sum(drift::INT) / count(*) * 1.5::DOUBLE / 2, 6) FROM y GROUP BY 1""")
def criterion_contributions(spark, sf_dir):
    fixed = _fixed(spark, sf_dir)
    moved = clusters.mean_distance_shift(fixed, 0.05)
    tables = {"distance": moved, "count": moved.select("label", (F.col("before").isNull() | F.col("after").isNull()).alias("drift"))}
    return rounded(reports.criterion_contributions(tables, {"distance": 0.5, "count": 1.5}))


@query("""WITH p AS (SELECT c_custkey, c_acctbal::DOUBLE AS x, (c_nationkey * 100)::DOUBLE AS y FROM customer), q AS (SELECT s_suppkey, s_acctbal::DOUBLE AS x, (s_nationkey * 100)::DOUBLE AS y FROM supplier),
d AS (SELECT s_suppkey AS point_id, c_custkey AS row_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS distance FROM q CROSS JOIN p),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, row_id) AS place FROM d) SELECT point_id, row_id, place::INT AS place, round(distance, 6) AS distance FROM r WHERE place <= 6""")
def nearest_customers(spark, sf_dir):
    """The six customers nearest to each supplier in the plane of balance and nation."""
    side = lambda t, k, name: read(spark, sf_dir, t).select(F.col(f"{k}key" if k == "c_cust" else "s_suppkey").alias(name), F.array(F.col(f"{k[0]}_acctbal").cast("double"), (F.col(f"{k[0]}_nationkey") * 100).cast("double")).alias("center"))
    return rounded(reports.nearest_rows(side("supplier", "s_supp", "point_id"), side("customer", "c_cust", "row_id")))


@query("""WITH k AS (SELECT o_orderpriority AS u, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 150000 THEN 2 WHEN o_totalprice < 200000 THEN 3 ELSE 4 END AS v FROM orders), t AS (SELECT u, v, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT DISTINCT u FROM t), best AS (SELECT max(coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) + coalesce(d.n, 0) + coalesce(e.n, 0)) AS hits FROM p pa JOIN p pb ON pb.u <> pa.u JOIN p pc ON pc.u NOT IN (pa.u, pb.u) JOIN p pd ON pd.u NOT IN (pa.u, pb.u, pc.u) JOIN p pe ON pe.u NOT IN (pa.u, pb.u, pc.u, pd.u)
 LEFT JOIN t a ON a.u = pa.u AND a.v = 0 LEFT JOIN t b ON b.u = pb.u AND b.v = 1 LEFT JOIN t c ON c.u = pc.u AND c.v = 2 LEFT JOIN t d ON d.u = pd.u AND d.v = 3 LEFT JOIN t e ON e.u = pe.u AND e.v = 4)
SELECT (SELECT count(*) FROM k) AS rows, 0::BIGINT AS outliers, round(hits / (SELECT count(*) FROM k), 6) AS accuracy, round(hits / (SELECT count(*) FROM k), 6) AS accuracy_with_outliers FROM best""")
def matched_clustering_accuracy(spark, sf_dir):
    """Price bands as clusters of orders, matched to priorities; the twin tries all five-way matchings."""
    price = F.col("o_totalprice")
    band = F.when(price < 50000, 0).when(price < 100000, 1).when(price < 150000, 2).when(price < 200000, 3).otherwise(4)
    return rounded(reports.clustering_accuracy(read(spark, sf_dir, "orders").withColumn("band", band), "o_orderpriority", "band"))
