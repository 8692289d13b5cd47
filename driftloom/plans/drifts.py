"""Queries over streams of errors whose concept moves: detectors, localisation and reports of the drifts that they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import detectors, reports
from driftloom.operators import windows as wn
from driftloom.operators.ordered import numbered
from driftloom.sources.scratch import materialize
from driftloom.sources.tables import read

from .registry import query, rounded

#: Errors of the rule value >= 3 on one stream for each type of event. The labels follow that rule up to 2024-01-15 and
#: value >= 60 from then on; one event in twenty is labelled the other way.
MOVED = """e AS MATERIALIZED (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
 (((CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value >= 3 ELSE value >= 60 END) <> (value >= 3)) <> (event_id % 20 = 0))::INT AS err FROM events)"""


def moved_errors(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    rule = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("value") >= 3).otherwise(F.col("value") >= 60)
    wrong = (rule != (F.col("value") >= 3)) != (F.col("event_id") % 20 == 0)
    rows = rows.select(F.col("event_type").alias("stream_id"), "ts", "event_id", wrong.cast("int").alias("err"))
    return numbered(rows, ["stream_id"], ["ts", "event_id"], "_at").select("stream_id", (F.col("_at") - 1).alias("seq"), "err")


def _fold(name: str, state: dict[str, str], rows: str) -> str:
    """A recursive fold of one detector. `state` maps columns to their start; `rows` selects, from `now` (the state before, with
    seq and err of the next row), the state after, and whether there is a warning or a drift."""
    again = ", ".join(f"CASE WHEN drift THEN {start} ELSE {column} END" for column, start in state.items())
    return f"""{name} AS (SELECT stream_id, -1::BIGINT AS seq, {', '.join(f'{v} AS {k}' for k, v in state.items())}, -1::BIGINT AS warned, -1::BIGINT AS late, NULL::BIGINT AS hit FROM (SELECT DISTINCT stream_id FROM e)
 UNION ALL SELECT stream_id, seq, {again}, CASE WHEN drift THEN -1 WHEN warning THEN (CASE WHEN warned < 0 THEN seq ELSE warned END) WHEN warned >= 0 AND seq - late > 100 THEN -1 ELSE warned END,
  CASE WHEN warning AND NOT drift THEN seq ELSE late END, CASE WHEN drift THEN (CASE WHEN warned >= 0 THEN warned ELSE seq END) END
 FROM ({rows.replace('now', f"(SELECT s.* EXCLUDE (seq), e.* EXCLUDE (stream_id) FROM {name} s JOIN e ON e.stream_id = s.stream_id AND e.seq = s.seq + 1)")}))"""


DDM = _fold("ddm", {"n": "0", "p": "0::DOUBLE", "bp": "'inf'::DOUBLE", "bs": "'inf'::DOUBLE"}, """SELECT *, n >= 30 AND p + s > bp + 2 * bs AS warning, n >= 30 AND p + s > bp + 3 * bs AS drift
 FROM (SELECT * REPLACE (CASE WHEN n >= 30 AND p + s <= bp + bs THEN p ELSE bp END AS bp, CASE WHEN n >= 30 AND p + s <= bp + bs THEN s ELSE bs END AS bs)
 FROM (SELECT *, sqrt(p * (1 - p) / n) AS s FROM (SELECT * REPLACE (n + 1 AS n, p + (err - p) / (n + 1) AS p) FROM now)))""")
EDDM = _fold("eddm", {"n": "0", "prev": "0", "k": "0", "mean": "0::DOUBLE", "m2": "0::DOUBLE", "top": "0::DOUBLE"}, """SELECT * REPLACE (CASE WHEN err = 0 THEN top WHEN k < 30 THEN greatest(top, level) WHEN level >= top THEN level ELSE top END AS top),
 err = 1 AND k >= 30 AND level < top AND level / top < 0.95 AS warning, err = 1 AND k >= 30 AND level < top AND level / top < 0.9 AS drift
 FROM (SELECT *, CASE WHEN k > 0 THEN mean + 2 * sqrt(m2 / k) END AS level FROM (SELECT * REPLACE (CASE WHEN err = 1 THEN m2 + (gap - old) * (gap - mean) ELSE m2 END AS m2)
 FROM (SELECT * REPLACE (CASE WHEN err = 1 THEN mean + (gap - mean) / k ELSE mean END AS mean), mean AS old FROM (SELECT * REPLACE (n + 1 AS n, CASE WHEN err = 1 THEN n + 1 ELSE prev END AS prev, k + err AS k), n + 1 - prev AS gap FROM now))))""")
FHDDM = _fold("fhddm", {"n": "0", "top": "0::DOUBLE"}, """SELECT *, false AS warning, n >= 100 AND top - r > sqrt(ln(1 / 1e-6::DOUBLE) / 200) AS drift
 FROM (SELECT * REPLACE (CASE WHEN n >= 100 THEN greatest(top, r) ELSE top END AS top) FROM (SELECT * REPLACE (n + 1 AS n), right100 / 100 AS r FROM now))""")
HDDM_A = _fold("hddm_a", {"n": "0", "total": "0::DOUBLE", "cn": "0", "ct": "0::DOUBLE"}, """SELECT *, cn < n AND total / n - ct / cn >= sqrt((n - cn) / n / cn * ln(1 / 0.005::DOUBLE) / 2) AS warning, cn < n AND total / n - ct / cn >= sqrt((n - cn) / n / cn * ln(1 / 0.001::DOUBLE) / 2) AS drift
 FROM (SELECT * REPLACE (CASE WHEN cut THEN n ELSE cn END AS cn, CASE WHEN cut THEN total ELSE ct END AS ct) FROM (SELECT *, cn = 0 OR ct / cn + sqrt(ln(1 / 0.001::DOUBLE) / (2 * cn)) >= total / n + sqrt(ln(1 / 0.001::DOUBLE) / (2 * n)) AS cut
 FROM (SELECT * REPLACE (n + 1 AS n, total + err AS total) FROM now)))""")
HDDM_W = _fold("hddm_w", {"tm": "NULL::DOUBLE", "tv": "NULL::DOUBLE", "cm": "NULL::DOUBLE", "cv": "NULL::DOUBLE", "am": "NULL::DOUBLE", "av": "NULL::DOUBLE"}, """SELECT *, coalesce(am - cm > sqrt((cv + av) * ln(1 / 0.005::DOUBLE) / 2), false) AS warning, coalesce(am - cm > sqrt((cv + av) * ln(1 / 0.001::DOUBLE) / 2), false) AS drift
 FROM (SELECT * REPLACE (CASE WHEN cut THEN tm ELSE cm END AS cm, CASE WHEN cut THEN tv ELSE cv END AS cv, CASE WHEN cut THEN NULL WHEN am IS NULL THEN err ELSE 0.05::DOUBLE * err + (1 - 0.05::DOUBLE) * am END AS am,
  CASE WHEN cut THEN NULL WHEN av IS NULL THEN 1 ELSE 0.05::DOUBLE * 0.05::DOUBLE + (1 - 0.05::DOUBLE) * (1 - 0.05::DOUBLE) * av END AS av)
 FROM (SELECT *, cm IS NULL OR tm + sqrt(tv * ln(1 / 0.001::DOUBLE) / 2) <= cm + sqrt(cv * ln(1 / 0.001::DOUBLE) / 2) AS cut
 FROM (SELECT * REPLACE (CASE WHEN tm IS NULL THEN err ELSE 0.05::DOUBLE * err + (1 - 0.05::DOUBLE) * tm END AS tm, CASE WHEN tv IS NULL THEN 1 ELSE 0.05::DOUBLE * 0.05::DOUBLE + (1 - 0.05::DOUBLE) * (1 - 0.05::DOUBLE) * tv END AS tv) FROM now)))""")
FOLDED = ("ddm", "eddm", "fhddm", "hddm_a", "hddm_w")
WITH_FRAMES = MOVED.replace("e AS MATERIALIZED", "e0 AS MATERIALIZED") + ", e AS MATERIALIZED (SELECT *, sum(1 - err) OVER (PARTITION BY stream_id ORDER BY seq ROWS 99 PRECEDING) AS right100 FROM e0)"


@query(f"""WITH RECURSIVE {WITH_FRAMES}, {DDM}, {EDDM}, {FHDDM}, {HDDM_A}, {HDDM_W}, found AS ({' UNION ALL '.join(f"SELECT '{d}' AS detector, stream_id, seq, hit FROM {d} WHERE hit IS NOT NULL" for d in FOLDED)})
SELECT detector, stream_id, row_number() OVER (PARTITION BY detector, stream_id ORDER BY seq) - 1 AS drift, hit AS warned_at, seq AS detected_at FROM found""")
def detector_comparison(spark, sf_dir):
    """The twin folds each detector by recursion; ADWIN, whose window of buckets SQL can't fold, is in adwin_drifts."""
    return detectors.detect_all(moved_errors(spark, sf_dir), FOLDED)


@query()
def adwin_drifts(spark, sf_dir):
    return detectors.detect(moved_errors(spark, sf_dir), "adwin")


def found_drifts(spark, sf_dir):
    """The stream of errors and the drifts that DDM finds in it, with starts and ends."""
    e = materialize(moved_errors(spark, sf_dir), "moved-errors")
    drifts = materialize(detectors.detect(e, "ddm"), "drifts")
    return e, detectors.end_by_peak(e, detectors.start_by_cusum(e, drifts))


LOCALISED = f"""{WITH_FRAMES}, {DDM}, hits AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS drift, hit AS warned_at, seq AS det, greatest(seq - 300, 0) AS a, least(50, (seq - greatest(seq - 300, 0)) // 4) AS head FROM ddm WHERE hit IS NOT NULL),
back AS (SELECT h.*, e.seq, e.err, avg(CASE WHEN e.seq < a + head THEN err END) OVER (PARTITION BY h.stream_id, drift) AS base FROM hits h JOIN e ON e.stream_id = h.stream_id AND e.seq >= a AND e.seq < det),
summed AS (SELECT *, sum(CASE WHEN seq < a + head THEN 0 ELSE err - base - 0.1::DOUBLE END) OVER (PARTITION BY stream_id, drift ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM back),
cus AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY stream_id, drift ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS s FROM summed),
starts AS (SELECT stream_id, drift, min(seq) AS crossed FROM cus WHERE seq >= a + head AND s > 1.5 GROUP BY ALL),
wins AS (SELECT h.stream_id, drift, (e.seq - det - 1) // 20 AS k, avg(err) AS rate, max(e.seq) AS last, count(*) AS n FROM hits h JOIN e ON e.stream_id = h.stream_id AND e.seq BETWEEN det + 1 AND det + 200 GROUP BY ALL),
falls AS (SELECT *, lead(rate) OVER (PARTITION BY stream_id, drift ORDER BY k) AS nxt FROM wins WHERE n = 20),
ends AS (SELECT stream_id, drift, min(last) AS fell FROM falls WHERE nxt < rate GROUP BY ALL), limits AS (SELECT stream_id, drift, max(last) AS lim FROM wins GROUP BY ALL),
loc AS (SELECT h.stream_id, drift, warned_at, det, CASE WHEN det < 50 THEN 0 WHEN det - a < 20 THEN a ELSE coalesce(crossed, a + head) END AS start, coalesce(fell, lim, det) AS stop FROM hits h LEFT JOIN starts USING (stream_id, drift) LEFT JOIN ends USING (stream_id, drift) LEFT JOIN limits USING (stream_id, drift))"""
RATES = """near AS (SELECT l.*, e.seq, e.err, CASE WHEN count(*) OVER w = 50 THEN avg(err) OVER w END AS rate FROM loc l JOIN e ON e.stream_id = l.stream_id AND e.seq BETWEEN least(start - 25, det - 50) AND greatest(stop + 50, det)
 WINDOW w AS (PARTITION BY l.stream_id, drift ORDER BY e.seq ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
described AS (SELECT stream_id, drift, warned_at, det, start, stop, avg(err) FILTER (seq BETWEEN start - 25 AND start + 25) AS rate_warning, avg(err) FILTER (seq BETWEEN det - 49 AND det) AS rate_detection, max(rate) FILTER (seq BETWEEN start AND stop) AS rate_peak FROM near GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {LOCALISED}, {RATES} SELECT stream_id, drift, warned_at, det AS detected_at, start, stop AS "end", round(rate_warning, 6) AS rate_warning, round(rate_detection, 6) AS rate_detection, round(rate_peak, 6) AS rate_peak, stop - start AS duration FROM described""")
def drift_descriptions(spark, sf_dir):
    e, localised = found_drifts(spark, sf_dir)
    return rounded(detectors.describe(e, localised))


@query(f"""WITH RECURSIVE {LOCALISED}, {RATES}, r AS (SELECT stream_id, seq, avg(err) OVER w AS rate, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
p AS (SELECT d.stream_id, drift, arg_max(r.seq, (r.rate, -r.seq)) AS peak, max(r.rate) AS rate FROM described d JOIN r ON r.stream_id = d.stream_id AND n = 100 AND r.seq BETWEEN start AND stop GROUP BY ALL),
m AS (SELECT stream_id, drift, start, rate_warning AS w, coalesce(peak, stop) AS stop, coalesce(rate, rate_peak) AS rate FROM described LEFT JOIN p USING (stream_id, drift))
SELECT stream_id, drift, start, stop AS "end", stop - start AS duration, round(w, 6) AS rate_start, round(rate, 6) AS rate_end, round(rate - w, 6) AS increase, round(CASE WHEN w > 0 THEN (rate - w) / w * 100 END, 6) AS change_pct FROM m""")
def corrected_drift_report(spark, sf_dir):
    e, localised = found_drifts(spark, sf_dir)
    peaks = wn.peak_in_range(wn.sliding_error_rate(e, 100), localised).select("stream_id", "drift", "peak", "rate")
    return rounded(reports.drift_report(detectors.describe(e, localised), peaks))


@query(f"""WITH RECURSIVE {LOCALISED}, x AS (SELECT stream_id, count(*) AS n, 1 - avg(err) AS accuracy FROM e GROUP BY 1), d AS (SELECT stream_id, count(*) AS drifts, avg(stop - start) AS m, min(stop - start) AS lo, max(stop - start) AS hi FROM loc GROUP BY 1)
SELECT stream_id, n, round(accuracy, 6) AS accuracy, coalesce(drifts, 0) AS drifts, round(m, 6) AS avg_duration, lo AS min_duration, hi AS max_duration FROM x LEFT JOIN d USING (stream_id)""")
def error_stream_summary(spark, sf_dir):
    e, localised = found_drifts(spark, sf_dir)
    found = detectors.error_summary(e, localised.withColumn("duration", F.col("end") - F.col("start")))
    return rounded(found.select("stream_id", "n", "accuracy", "drifts", F.col("mean_duration").alias("avg_duration"), "min_duration", "max_duration"))
