"""Sliding, smoothing and run operators over ordered streams and over window labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .ordered import STRETCH, in_stretch, running, segmented, with_halo

STREAM = "stream_id"


def _frame(rows: DataFrame, before: int, after: int) -> tuple[DataFrame, Window]:
    return with_halo(rows, "seq", before, after), in_stretch([STREAM], "seq")


def sliding_error_rate(errors: DataFrame, width: int) -> DataFrame:
    """Mean error of rows seq .. seq + width - 1, for every full window of each stream (stream_id, gapless seq, err)."""
    rows, w = _frame(errors, 0, width - 1)
    frame = w.rowsBetween(0, width - 1)
    out = rows.select(STREAM, "seq", "_own", F.avg("err").over(frame).alias("rate"), F.count("err").over(frame).alias("_held"))
    return out.where((F.col("_held") == width) & F.col("_own")).drop("_held", "_own")


def gradient_start(errors: DataFrame, width: int = 20, rise: float = 0.01) -> DataFrame:
    """First position of each stream at which the moving average of `width` rows rises by more than `rise` to the next."""
    rows, w = _frame(errors, 0, width)
    now, then = (F.avg("err").over(w.rowsBetween(i, i + width - 1)) for i in (0, 1))
    held = F.count("err").over(w.rowsBetween(0, width))
    steps = rows.select(STREAM, "seq", "_own", (then - now).alias("step"), held.alias("_held"))
    return steps.where((F.col("_held") == width + 1) & F.col("_own") & (F.col("step") > rise)).groupBy(STREAM).agg(F.min("seq").alias("start"))


def median_filter(rows: DataFrame, kernel: int, value: str = "value") -> DataFrame:
    """Median of the `kernel` rows around each row; the first and last values are repeated beyond the edges."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half = kernel // 2
    ends = rows.groupBy(STREAM).agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    cut, order = _frame(rows, half, half)
    w = order.rowsBetween(-half, half)
    framed = cut.select(STREAM, "seq", "_own", F.collect_list(value).over(w).alias("_around"), F.first(value).over(w).alias("_from"), F.last(value).over(w).alias("_to"))
    framed = framed.where("_own").join(ends, STREAM)
    missing = lambda edge: F.greatest(half - F.abs(F.col("seq") - F.col(edge)), F.lit(0)).cast("int")
    full = F.array_sort(F.concat(F.array_repeat("_from", missing("_low")), "_around", F.array_repeat("_to", missing("_high"))))
    return framed.select(STREAM, "seq", F.get(full, F.lit(half)).alias("smooth"))


def median_filter_2d(matrix: DataFrame, kernel: int) -> DataFrame:
    """(i, j, value) smoothed by the median of the kernel x kernel cells around, indexes clamped to the matrix."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half = kernel // 2
    last = matrix.agg(F.max("i").alias("i1"), F.max("j").alias("j1"), F.min("i").alias("i0"), F.min("j").alias("j0"))
    shift = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    around = matrix.select("i", "j").withColumn("di", shift).withColumn("dj", shift).crossJoin(F.broadcast(last))  # one row
    clamp = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    at = around.select("i", "j", clamp(F.col("i") + F.col("di"), F.col("i0"), F.col("i1")).alias("ci"), clamp(F.col("j") + F.col("dj"), F.col("j0"), F.col("j1")).alias("cj"))
    cells = matrix.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "value")
    return at.join(cells, ["ci", "cj"]).groupBy("i", "j").agg(F.median("value").alias("smooth"))


def repair_outliers(labels: DataFrame) -> DataFrame:
    """Labels (stream_id, win, label) where a window between two equal real labels takes theirs, left to right, so that a
    repaired label counts for the next window.

    Each stream is one ordered fold that holds a window and the one before it, batch by batch; streams run in parallel.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, done, held = None, None, None  # the last settled label, and the window that waits for the next one
        for pdf in batches:
            out = []
            for s, win, label in zip(pdf[STREAM], pdf["win"], pdf["label"], strict=True):
                if held is not None:
                    same = s == stream and done is not None and done == label and done != -1
                    done = done if same else held[1]
                    out.append((stream, held[0], done))
                if held is None or s != stream:
                    stream, done = s, None
                held = win, label
            yield pd.DataFrame(out, columns=[STREAM, "win", "label"])
        yield pd.DataFrame([] if held is None else [(stream, *held)], columns=[STREAM, "win", "label"])

    win = labels.schema["win"].dataType.simpleString()
    ordered = labels.select(STREAM, "win", F.col("label").cast("int").alias("label")).repartition(STREAM).sortWithinPartitions(STREAM, "win")
    return ordered.mapInPandas(fold, f"{STREAM} string, win {win}, label int")


def change_points(labels: DataFrame) -> DataFrame:
    """Windows whose label differs from that of the last window before that is not an outlier (-1)."""
    cut = segmented(labels.where("label <> -1"), "win")
    last = cut.groupBy(STREAM, STRETCH).agg(F.max_by("label", "win").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(STREAM).orderBy(STRETCH))).drop("_last")  # a row for each stretch
    old = F.coalesce(F.lag("label").over(in_stretch([STREAM], "win")), F.col("_before"))
    found = cut.join(before, [STREAM, STRETCH]).withColumn("old", old)
    leading = labels.groupBy(STREAM).agg((F.min_by("label", "win") == -1).alias("led"))
    changed = (F.col("old") != F.col("label")) | (F.col("old").isNull() & F.col("led"))
    return found.join(leading, STREAM).where(changed).select(STREAM, "win", F.coalesce("old", F.lit(-1)).alias("old"), "label")


def runs(rows: DataFrame, order: str = "seq", label: str = "label") -> DataFrame:
    """Stretches of equal labels: number, label, first and last position, length. Positions are gapless."""
    previous = F.lag(label).over(in_stretch([STREAM], order))
    changed = F.coalesce((F.col(label) != previous).cast("int"), F.lit(0))
    marked = with_halo(materialize(rows.select(STREAM, order, label), "runs"), order, 1, 0).withColumn("_changed", changed).where("_own")
    run = running(marked, [STREAM], [order], {"_changed": "changed"}).withColumnRenamed("run_changed", "run")
    return run.groupBy(STREAM, "run").agg(F.min(label).alias("label"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def cusum(errors: DataFrame, baseline: float, slack: float = 0.1) -> DataFrame:
    """s = max(0, s + err - baseline - slack) along each stream, by the identity of a running sum with its running minimum.

    Each stretch of a stream sends its sum and its smallest running sum ahead.
    """
    up_to = Window.unboundedPreceding, 0
    w = in_stretch([STREAM], "seq").rowsBetween(*up_to)
    rows = segmented(materialize(errors.select(STREAM, "seq", "err"), "errors"), "seq").withColumn("_sum", F.sum(F.col("err") - (baseline + slack)).over(w))
    rows = rows.withColumn("_low", F.min("_sum").over(w))
    parts = rows.groupBy(STREAM, STRETCH).agg(F.max_by("_sum", "seq").alias("_all"), F.min("_low").alias("_least"))
    earlier = Window.partitionBy(STREAM).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    parts = parts.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    parts = parts.withColumn("_least_before", F.min(F.col("_base") + F.col("_least")).over(earlier)).drop("_all", "_least")
    rows = rows.join(parts, [STREAM, STRETCH])
    low = F.least(F.lit(0.0), F.col("_base") + F.col("_low"), F.col("_least_before"))
    return rows.select(STREAM, "seq", (F.col("_base") + F.col("_sum") - low).alias("s"))


def cusum_crossing(errors: DataFrame, baseline: float, slack: float = 0.1, threshold: float = 1.5) -> DataFrame:
    """First position of each stream at which the sum exceeds the threshold."""
    return cusum(errors, baseline, slack).where(F.col("s") > threshold).groupBy(STREAM).agg(F.min("seq").alias("start"))


def peak_in_range(rates: DataFrame, drifts: DataFrame) -> DataFrame:
    """For each drift (stream_id, drift, start, end) the first position of the largest rate within it."""
    within = rates.join(drifts, (rates[STREAM] == drifts[STREAM]) & rates["seq"].between(drifts["start"], drifts["end"])).select(rates[STREAM], "drift", "seq", "rate")
    return within.groupBy(STREAM, "drift").agg(F.max_by("seq", F.struct(F.col("rate"), -F.col("seq"))).alias("peak"), F.max("rate").alias("rate"))
