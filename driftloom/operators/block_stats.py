"""Shift of descriptive statistics between two blocks, by class and feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import null_safe_join, quantiles

STATISTICS = ("mean", "std", "min", "max", "median")


def group_stats(long: DataFrame, keys: Sequence[str] = ("label", "feature", "block")) -> DataFrame:
    """Mean, sample standard deviation, minimum, maximum and median of `value` by keys."""
    plain = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("n"),
    )
    cells = null_safe_join(plain, quantiles(long, keys, {"median": 0.5}), keys, "left")
    return cells.select(*keys, "mean", "std", "min", "max", "median", "n")


def relative_shift(old: Column, new: Column, epsilon: float = 1e-10) -> Column:
    return F.try_divide(new - old, F.abs(old + epsilon))


def stats_shift(long: DataFrame, threshold: float = 0.2, two_sided: bool = False) -> DataFrame:
    """(label, feature, stat, before, after, shift, drift); a class missing in a block counts as 0 there.

    drift is one-sided unless two_sided is set: only rises above the threshold count.
    """
    side = lambda b: F.struct(*[F.max(F.when(F.col("block") == b, F.col(s))).alias(s) for s in STATISTICS]).alias(b)
    wide = group_stats(long).groupBy("label", "feature").agg(side("before"), side("after"))
    stat = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"before.{s}").alias("b"), F.col(f"after.{s}").alias("a")) for s in STATISTICS]))
    rows = wide.select("label", "feature", stat.alias("s")).select("label", "feature", "s.stat", F.coalesce("s.b", F.lit(0.0)).alias("before"), F.coalesce("s.a", F.lit(0.0)).alias("after"))
    shift = relative_shift(F.col("before"), F.col("after"))
    return rows.withColumn("shift", shift).withColumn("drift", (F.abs("shift") if two_sided else F.col("shift")) > threshold)


def stats_vote(shifts: DataFrame, decision: float = 0.4) -> DataFrame:
    """For each statistic whether any class and feature drifts, and the overall decision: the share of such statistics
    exceeds `decision`."""
    per_stat = shifts.groupBy("stat").agg(F.bool_or("drift").alias("stat_drift"))
    overall = F.avg(F.col("stat_drift").cast("double")).over(Window.partitionBy()) > decision  # a row for each statistic
    return per_stat.select("stat", "stat_drift", overall.alias("drift"))


def class_ratio_shift(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Share of each class in its block, and the relative shift of the share."""
    counts = df.groupBy("label").pivot("block", ["before", "after"]).count().fillna(0)
    share = lambda b: F.coalesce(F.try_divide(F.col(b), F.sum(b).over(Window.partitionBy())), F.lit(0.0))  # noqa: E731  a row for each class
    rows = counts.select("label", share("before").alias("ratio_before"), share("after").alias("ratio_after"))
    return rows.withColumn("shift", relative_shift(F.col("ratio_before"), F.col("ratio_after"))).withColumn("drift", F.col("shift") > threshold)


def summary(long: DataFrame) -> DataFrame:
    """Median, mean and standard deviation before and after, and the change in percent, by class and feature."""
    stats = group_stats(long)
    at = lambda b, s: F.max(F.when(F.col("block") == b, F.col(s))).alias(f"{s}_{b}")
    wide = stats.groupBy("label", "feature").agg(*[at(b, s) for s in ("median", "mean", "std") for b in ("before", "after")])
    change = lambda s: (F.col(f"{s}_after") - F.col(f"{s}_before")) / F.col(f"{s}_before") * 100
    return wide.select("*", *[F.when(F.col(f"{s}_before") != 0, change(s)).alias(f"{s}_change_pct") for s in ("median", "mean", "std")])


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """Share of one class in each block and its change."""
    of = lambda b: F.avg(F.when(F.col("block") == b, (F.col("label") == label).cast("double")))
    return df.agg(of("before").alias("before"), of("after").alias("after")).withColumn("delta", F.col("after") - F.col("before"))
