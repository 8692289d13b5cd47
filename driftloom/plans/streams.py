"""Queries over ordered streams and row windows: error streams, runs, window distances, prototypes, recurring concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import recurrence as rc
from driftloom.operators import windows as wn
from driftloom.sources.tables import event_stream, read, row_windows

from .registry import query, rounded

SEQ = "ev AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)"
ERR = f"{SEQ}, err AS (SELECT 'events' AS stream_id, seq, (event_type = 'error')::INT AS err FROM ev)"


def errors(spark, sf_dir):
    return event_stream(spark, sf_dir).select(F.lit("events").alias("stream_id"), "seq", (F.col("event_type") == "error").cast("int").alias("err"))


@query(f"WITH {SEQ} SELECT event_id, (seq // 1000)::INT AS win FROM ev WHERE seq // 1000 < (SELECT count(*) // 1000 FROM events)")
def row_windows_1000(spark, sf_dir):
    return row_windows(event_stream(spark, sf_dir), 1000).select("event_id", "win")


@query(f"WITH {ERR} SELECT stream_id, seq, round(r, 6) AS rate FROM (SELECT *, avg(err) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS r FROM err) WHERE seq <= (SELECT count(*) FROM err) - 100")
def sliding_error_rate(spark, sf_dir):
    return rounded(wn.sliding_error_rate(errors(spark, sf_dir), 100))


MAJORITY = f"""{SEQ}, before AS (SELECT e.seq, e.event_type, c.event_type AS cand, count(*) FILTER (e.event_type = c.event_type) OVER (PARTITION BY c.event_type ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
 FROM ev e CROSS JOIN (SELECT DISTINCT event_type FROM events) c)"""


@query(f"WITH {MAJORITY} SELECT seq, CASE WHEN seq = 0 THEN 1 ELSE (arg_max(cand, (n, cand)) <> any_value(event_type))::INT END AS err FROM before GROUP BY seq")
def majority_error_stream(spark, sf_dir):
    from driftloom.operators.detectors import majority_errors

    rows = event_stream(spark, sf_dir).select(F.lit("events").alias("stream_id"), "seq", F.col("event_type").alias("label"))
    return majority_errors(rows).select("seq", "err")


CUSUM = f"""{ERR}, s AS (SELECT seq, sum(err - 0.3::DOUBLE) OVER (ORDER BY seq) AS total FROM err), c AS (SELECT seq, total - least(0, min(total) OVER (ORDER BY seq)) AS s FROM s)"""


@query(f"WITH {CUSUM} SELECT 'events' AS stream_id, seq, round(s, 6) AS s FROM c")
def cusum_path(spark, sf_dir):
    return rounded(wn.cusum(errors(spark, sf_dir), 0.2, 0.1))


@query(f"WITH {CUSUM} SELECT 'events' AS stream_id, min(seq) AS start FROM c WHERE s > 1.55")
def cusum_first_crossing(spark, sf_dir):
    return wn.cusum_crossing(errors(spark, sf_dir), 0.2, 0.1, 1.55)


@query(f"""WITH {ERR}, r AS (SELECT seq, avg(err) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS rate FROM err), d AS (SELECT seq, lead(rate) OVER (ORDER BY seq) - rate AS step FROM r WHERE seq <= (SELECT count(*) FROM err) - 20)
SELECT 'events' AS stream_id, min(seq) AS start FROM d WHERE step > 0.01""")
def gradient_start(spark, sf_dir):
    return wn.gradient_start(errors(spark, sf_dir))


@query(f"""WITH {ERR}, r AS (SELECT seq, avg(err) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS rate FROM err),
d AS (SELECT * FROM (VALUES (0, 100, 400), (1, 300, 900), (2, 1000, 5000)) t(drift, a, b)), f AS (SELECT * FROM r WHERE seq <= (SELECT count(*) FROM err) - 100)
SELECT 'events' AS stream_id, drift, arg_max(seq, (rate, -seq)) AS peak, round(max(rate), 6) AS rate FROM f JOIN d ON seq BETWEEN a AND b GROUP BY drift""")
def peak_in_range(spark, sf_dir):
    drifts = spark.createDataFrame([("events", 0, 100, 400), ("events", 1, 300, 900), ("events", 2, 1000, 5000)], "stream_id string, drift int, start long, end long")
    return rounded(wn.peak_in_range(wn.sliding_error_rate(errors(spark, sf_dir), 100), drifts))


@query(f"""WITH {SEQ}, c AS (SELECT seq, event_type, sum((event_type IS DISTINCT FROM p AND p IS NOT NULL)::INT) OVER (ORDER BY seq) AS run FROM (SELECT *, lag(event_type) OVER (ORDER BY seq) AS p FROM ev))
SELECT run::BIGINT AS run, min(event_type) AS label, min(seq) AS first, max(seq) AS last, count(*) AS length FROM c GROUP BY run""")
def label_runs(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.lit("events").alias("stream_id"), "seq", F.col("event_type").alias("label"))
    return wn.runs(rows).drop("stream_id")


TOP = f"""{SEQ}, w AS (SELECT (seq // 100)::INT AS win, event_type FROM ev WHERE seq // 100 < (SELECT count(*) // 100 FROM events)), n AS (SELECT win, event_type, count(*) AS n FROM w GROUP BY ALL),
lab AS (SELECT win, CASE arg_max(event_type, (n, event_type)) WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 2 END AS label FROM n GROUP BY win)"""


def window_labels(spark, sf_dir):
    wins = row_windows(event_stream(spark, sf_dir), 100)
    top = wins.groupBy("win", "event_type").count().groupBy("win").agg(F.max_by("event_type", F.struct("count", "event_type")).alias("top"))
    label = F.when(F.col("top") == "click", 0).when(F.col("top") == "view", 1).when(F.col("top") == "error", -1).otherwise(2)
    return top.select(F.lit("events").alias("stream_id"), "win", label.alias("label"))


@query(f"""WITH {TOP}, r AS (SELECT *, lag(label) OVER (ORDER BY win) AS old FROM lab WHERE label <> -1)
SELECT win, coalesce(old, -1)::INT AS old, label FROM r WHERE old <> label OR (old IS NULL AND (SELECT label FROM lab ORDER BY win LIMIT 1) = -1)""")
def change_points(spark, sf_dir):
    return wn.change_points(window_labels(spark, sf_dir)).select("win", "old", "label")


@query(f"""WITH RECURSIVE {TOP}, l AS (SELECT win, label, lead(label) OVER (ORDER BY win) AS ahead, row_number() OVER (ORDER BY win) AS k FROM lab),
r AS (SELECT k, win, label AS done FROM l WHERE k = 1 UNION ALL SELECT l.k, l.win, CASE WHEN r.done = l.ahead AND r.done <> -1 THEN r.done ELSE l.label END FROM r JOIN l ON l.k = r.k + 1)
SELECT 'events' AS stream_id, win, done AS label FROM r""")
def repaired_labels(spark, sf_dir):
    return wn.repair_outliers(window_labels(spark, sf_dir))


def _median_of(kernel: int) -> str:
    return f"""WITH {SEQ}, k AS (SELECT seq, unnest(range({-(kernel // 2)}, {kernel // 2 + 1})) AS d FROM ev), b AS (SELECT max(seq) AS hi FROM ev)
SELECT k.seq, round(median(v.value), 6) AS smooth FROM k, b, ev v WHERE v.seq = least(greatest(k.seq + k.d, 0), b.hi) GROUP BY k.seq"""


def _median_filtered(spark, sf_dir, kernel: int):
    rows = event_stream(spark, sf_dir).select(F.lit("events").alias("stream_id"), "seq", "value")
    return rounded(wn.median_filter(rows, kernel).select("seq", "smooth"))


@query(_median_of(9))
def median_filtered_values(spark, sf_dir):
    return _median_filtered(spark, sf_dir, 9)


@query(_median_of(5))
def median_filtered_stream(spark, sf_dir):
    return _median_filtered(spark, sf_dir, 5)


WIN = f"{SEQ}, w AS (SELECT (seq // 1000)::INT AS win, event_type AS label, value FROM ev WHERE seq // 1000 < (SELECT count(*) // 1000 FROM events))"


def labelled_windows(spark, sf_dir, size=1000):
    return row_windows(event_stream(spark, sf_dir), size).select("win", F.col("event_type").alias("label"), "value")


@query(f"WITH {WIN} SELECT win, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY win), 6) AS percent FROM w GROUP BY win, label")
def window_class_distribution(spark, sf_dir):
    return rounded(rc.class_distribution(labelled_windows(spark, sf_dir)))


@query(f"WITH {WIN}, n AS (SELECT win, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY win) AS p FROM w GROUP BY win, label) SELECT win, round(-sum(p * log2(p)), 6) AS entropy, round(max(n) / min(n), 6) AS imbalance FROM n GROUP BY win")
def window_entropy_imbalance(spark, sf_dir):
    return rounded(rc.entropy_and_imbalance(labelled_windows(spark, sf_dir)))


DIST = f"""{WIN}, m AS (SELECT win, label, avg(value) AS c FROM w GROUP BY ALL), wins AS (SELECT DISTINCT win FROM m),
dist AS (SELECT a.win AS win_a, b.win AS win_b, avg(CASE WHEN x.c IS NULL OR y.c IS NULL THEN 2 ELSE abs(x.c - y.c) END) AS distance FROM wins a JOIN wins b ON a.win < b.win CROSS JOIN (SELECT DISTINCT label FROM m) l
 LEFT JOIN m x ON x.win = a.win AND x.label = l.label LEFT JOIN m y ON y.win = b.win AND y.label = l.label WHERE x.c IS NOT NULL OR y.c IS NOT NULL GROUP BY ALL),
sq AS (SELECT win_a AS i, win_b AS j, distance AS value FROM dist UNION ALL SELECT win_b, win_a, distance FROM dist UNION ALL SELECT win, win, 0 FROM wins)"""


def distances(spark, sf_dir):
    return rc.window_distances(rc.class_means(labelled_windows(spark, sf_dir), ["value"]))


def matrix(spark, sf_dir):
    return rc.full_matrix(distances(spark, sf_dir), read(spark, sf_dir, "events").count() // 1000)


@query(f"WITH {DIST} SELECT win_a, win_b, round(distance, 6) AS distance FROM dist")
def window_distance_matrix(spark, sf_dir):
    return rounded(distances(spark, sf_dir))


@query(f"""WITH {DIST}, b AS (SELECT max(i) AS hi FROM sq), k AS (SELECT i, j, di, dj FROM sq CROSS JOIN (SELECT unnest([-1, 0, 1]) AS di) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dj))
SELECT k.i, k.j, round(median(v.value), 6) AS smooth FROM k, b, sq v WHERE v.i = least(greatest(k.i + di, 0), hi) AND v.j = least(greatest(k.j + dj, 0), hi) GROUP BY k.i, k.j""")
def median_filtered_matrix(spark, sf_dir):
    means = rc.class_means(labelled_windows(spark, sf_dir), ["value"])
    return rounded(rc.smoothed_matrix(means, read(spark, sf_dir, "events").count() // 1000, 3))


@query(f"WITH {DIST} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max FROM sq")
def distance_matrix_summary(spark, sf_dir):
    return rounded(rc.matrix_summary(matrix(spark, sf_dir)))


@query(f"""WITH {DIST}, p AS (SELECT distance / 100 AS distance, (win_a % 2) <> (win_b % 2) AS d FROM dist WHERE win_b - win_a > 1), t AS (SELECT k * 0.005::DOUBLE AS threshold FROM (SELECT unnest(range(200)) AS k)),
c AS (SELECT threshold, count(*) FILTER (d AND distance > threshold) AS tp, count(*) FILTER (d AND distance <= threshold) AS fn, count(*) FILTER (NOT d AND distance < threshold) AS tn, count(*) FILTER (NOT d AND distance >= threshold) AS fp FROM p CROSS JOIN t GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr FROM c)
SELECT round(threshold, 6) AS threshold, tp, fn, tn, fp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr,
 round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""")
def threshold_sweep(spark, sf_dir):
    d = distances(spark, sf_dir).withColumn("distance", F.col("distance") / 100)
    concepts = labelled_windows(spark, sf_dir).select("win").distinct().select("win", (F.col("win") % 2).alias("concept"))
    return rounded(rc.threshold_sweep(d, concepts))


@query(f"""WITH {DIST}, s AS (SELECT win_b AS win, distance AS value FROM dist WHERE win_b = win_a + 1), r AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM s WHERE win BETWEEN 2 AND 3)
SELECT win, round(value, 6) AS value, win >= 4 AND (value > mu + 3 * sd OR value < mu - 3 * sd) AS drift FROM s CROSS JOIN r""")
def block_metric_flags(spark, sf_dir):
    steps = distances(spark, sf_dir).where("win_b = win_a + 1").select(F.col("win_b").alias("win"), F.col("distance").alias("value"))
    return rounded(rc.block_metric_flags(steps, 4))


VEC = """e AS (SELECT vec_id, label, k, embedding[k]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
half AS (SELECT label, k, vec_id % 2 AS h, avg(x) AS c FROM e GROUP BY ALL), d AS (SELECT a.label, sqrt(sum((a.c - b.c) ** 2)) AS distance FROM half a JOIN half b ON a.label = b.label AND a.k = b.k AND a.h = 0 AND b.h = 1 GROUP BY 1)"""


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("center"))


def _mean_vector(rows):
    return rows.select("label", F.posexplode("center").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("center"))


@query(f"WITH {VEC} SELECT label, round(distance, 6) AS distance FROM d UNION ALL SELECT DISTINCT label, 10.0 FROM embeddings WHERE label NOT IN (SELECT label FROM d)")
def centroid_displacement_by_class(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(rc.displacement_by_class(_mean_vector(v.where("row_id % 2 = 0")), _mean_vector(v.where("row_id % 2 = 1"))))


PROTO = """p AS (SELECT vec_id AS pid, label AS cls, embedding AS v FROM embeddings WHERE vec_id % 25 = 0),
dd AS (SELECT e.vec_id, e.label, p.pid, p.cls, sqrt(list_sum(list_transform(range(1, 65), lambda k: (e.embedding[k]::DOUBLE - p.v[k]::DOUBLE) ** 2))) AS d FROM embeddings e CROSS JOIN p),
near AS (SELECT vec_id, any_value(label) AS label, arg_min(pid, (round(d, 9), pid)) AS pid, arg_min(cls, (round(d, 9), pid)) AS cls, min(d) AS d FROM dd GROUP BY 1)"""


def prototypes(spark, sf_dir):
    return vectors(spark, sf_dir).where("row_id % 25 = 0").select(F.col("row_id").alias("proto_id"), F.col("label").alias("class"), "center")


@query(f"WITH {PROTO} SELECT vec_id AS row_id, label, pid AS proto_id, cls AS proto_class, round(d, 6) AS distance FROM near")
def nearest_prototype_assignment(spark, sf_dir):
    return rounded(rc.nearest_prototype(vectors(spark, sf_dir), prototypes(spark, sf_dir)))


@query(f"WITH {PROTO}, n AS (SELECT label, count(*) AS size FROM near GROUP BY 1) SELECT label, pid AS proto_id, count(*) AS covered, round(count(*) / any_value(size), 6) AS share FROM near JOIN n USING (label) WHERE label = cls GROUP BY label, pid")
def prototype_coverage(spark, sf_dir):
    return rounded(rc.coverage(rc.nearest_prototype(vectors(spark, sf_dir), prototypes(spark, sf_dir))))


def _minimal(left: str) -> str:
    return f"""WITH a AS (SELECT vec_id, label AS c, embedding AS v FROM embeddings WHERE {left}), b AS (SELECT vec_id, label AS c, embedding AS v FROM embeddings WHERE NOT ({left})),
n AS (SELECT c, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb FROM (SELECT c, 'a' AS s FROM a UNION ALL SELECT c, 'b' FROM b) GROUP BY 1),
d AS (SELECT a.c, a.vec_id AS x, b.vec_id AS y, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) ** 2))) AS d FROM a JOIN b USING (c)),
ma AS (SELECT c, avg(d) AS m FROM (SELECT c, x, min(d) AS d FROM d GROUP BY ALL) GROUP BY 1), mb AS (SELECT c, avg(d) AS m FROM (SELECT c, y, min(d) AS d FROM d GROUP BY ALL) GROUP BY 1)
SELECT n.c AS class, round(coalesce(CASE WHEN na <= nb THEN ma.m ELSE mb.m END, 0) + 2 * abs(na - nb), 6) AS distance FROM n LEFT JOIN ma ON n.c = ma.c LEFT JOIN mb ON n.c = mb.c"""


def _sides(spark, sf_dir, left):
    v = vectors(spark, sf_dir).select(F.col("row_id").alias("proto_id"), F.col("label").alias("class"), "center")
    return rounded(rc.minimal_distance(v.where(left), v.where(~left)))


@query(_minimal("embedding[1] > 0"))
def minimal_distance(spark, sf_dir):
    """All embeddings on either side of zero in their first dimension."""
    return _sides(spark, sf_dir, F.col("center")[0] > 0)


@query(_minimal("vec_id % 2 = 0"))
def minimal_distance_halves(spark, sf_dir):
    """Two halves of all embeddings."""
    return _sides(spark, sf_dir, F.col("proto_id") % 2 == 0)


@query(f"""WITH {PROTO}, t AS (SELECT label AS u, cls AS v, count(*) AS n FROM near GROUP BY ALL), a AS (SELECT sum(n) AS m FROM t GROUP BY u), b AS (SELECT sum(n) AS m FROM t GROUP BY v),
s AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h, sum(n) AS tot FROM t), sa AS (SELECT sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM a), sb AS (SELECT sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM b),
x AS (SELECT s.p AS p, sa.p AS pa, sb.p AS pb, tot, sa.p * sb.p / (tot * (tot - 1) / 2) AS ex, ln(tot) - sb.h / tot AS hv, ln(tot) + (s.h - sa.h - sb.h) / tot AS mi FROM s, sa, sb)
SELECT round((p - ex) / ((pa + pb) / 2 - ex), 6) AS adjusted_rand, round(p / sqrt(pa * pb), 6) AS fowlkes_mallows, round(mi / hv, 6) AS completeness, round(mi, 6) AS mutual_information FROM x""")
def clustering_agreement(spark, sf_dir):
    assigned = rc.nearest_prototype(vectors(spark, sf_dir), prototypes(spark, sf_dir))
    return rounded(rc.agreement(rc.contingency(assigned, "label", "proto_class")))
