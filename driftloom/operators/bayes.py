"""Gaussian naive Bayes that predicts every row of a stream from the rows before it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .ordered import running, segmented

#: Distinct labels that are spread over columns.
MAX_LABELS = 64
#: Added to every variance, so that a class with one row has a width.
WIDTH = 0.01


def joint_log(count: float, sums: Sequence[float], squares: Sequence[float], x: Sequence[float], width: float = WIDTH) -> float:
    """Log of a class's rows times the density of x, up to a constant, from the class's count, sums and squares."""
    out = math.log(count)
    for s, q, v in zip(sums, squares, x, strict=True):
        mean = s / count
        var = max(q / count - mean * mean, 0.0) + width
        out -= 0.5 * (math.log(var) + (v - mean) * (v - mean) / var)
    return out


def _joint_log(label: int, features: Sequence[str], width: float) -> Column:
    n = F.col(f"_n_{label}")
    out = F.log(n)
    for f in range(len(features)):
        mean = F.col(f"_s_{label}_{f}") / n
        var = F.greatest(F.col(f"_q_{label}_{f}") / n - mean * mean, F.lit(0.0)) + width
        away = F.col(features[f]) - mean
        out = out - 0.5 * (F.log(var) + away * away / var)
    return out


def prequential(rows: DataFrame, features: Sequence[str], width: float = WIDTH) -> DataFrame:
    """(stream_id, seq, label, predicted, err) for rows (stream_id, gapless seq, label, features).

    Each row is predicted from the counts, sums and squares of each class over the rows of its stream before it, by running
    sums over stretches: no task sees a whole stream. The most likely class wins, of equal ones the smallest label; the first
    row of a stream has no prediction and counts as an error. Rows with a null feature or label are predicted (null, an error)
    but not learnt. Labels are few: more than MAX_LABELS are an error.
    """
    rows = materialize(rows.select("stream_id", "seq", "label", *[F.col(f).cast("double").alias(f) for f in features]), "prequential")
    labels = sorted(r.label for r in rows.where("label is not null").select("label").distinct().limit(MAX_LABELS + 1).collect())
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    whole = F.lit(True)
    for c in ("label", *features):
        whole = whole & F.col(c).isNotNull()
    own, sums = {}, {}
    for k, label in enumerate(labels):
        mine = whole & (F.col("label") == F.lit(label))
        own |= {f"_n_{k}": F.when(mine, 1.0).otherwise(0.0)}
        for f, name in enumerate(features):
            own |= {f"_s_{k}_{f}": F.when(mine, F.col(name)).otherwise(0.0), f"_q_{k}_{f}": F.when(mine, F.col(name) * F.col(name)).otherwise(0.0)}
    sums = {c: c for c in own}
    added = running(segmented(rows.withColumns(own), "seq"), ["stream_id"], ["seq"], sums)
    before = added.withColumns({c: F.col(f"run_{c}") - F.col(c) for c in own})
    scores = [F.struct(F.when(F.col(f"_n_{k}") > 0.5, _joint_log(k, features, width)).alias("s"), F.lit(-k).alias("k")) for k in range(len(labels))]
    best = F.array_max(F.filter(F.array(*scores), lambda x: x["s"].isNotNull())) if labels else F.lit(None).cast("struct<s:double,k:int>")
    names = F.array(*[F.lit(x) for x in labels]) if labels else F.array(F.lit(None).cast(rows.schema["label"].dataType))
    found = before.withColumn("_best", best["k"]).withColumn("predicted", F.when(F.col("_best").isNotNull(), F.get(names, -F.col("_best"))))
    return found.select("stream_id", "seq", "label", "predicted", (~F.coalesce(F.col("predicted") == F.col("label"), F.lit(False))).cast("int").alias("err"))
