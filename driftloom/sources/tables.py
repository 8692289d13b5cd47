"""Tables as sources of drift analyses: labelled blocks, ordered streams and row windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_blocks(df: DataFrame, is_before: Column) -> DataFrame:
    """Adds `block`: 'before' where is_before holds, else 'after'."""
    return df.withColumn("block", F.when(is_before, "before").otherwise("after"))


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row for each feature of a row: keys, feature, value. One shuffle then serves all features."""
    return df.unpivot(list(keys), [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def with_sequence(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "seq") -> DataFrame:
    """Adds the gapless position (from 0) of each row in the total order of `order`.

    `bucket` must not decrease along that order. Rows are numbered inside their bucket and buckets are offset by the
    counts before them, so no task sees the whole stream; only the counts of buckets are put in order in one place.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    numbered = rows.join(offsets, "_bucket").withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
    return numbered.drop("_bucket", "_offset")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with seq, in the order of (ts, event_id)."""
    return with_sequence(read(spark, sf_dir, "events"), ["ts", "event_id"], F.date_trunc("hour", "ts"))


def row_windows(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Adds `win`, the non-overlapping window of `size` rows; the trailing partial window goes."""
    total = df.agg((F.floor(F.count("*") / size)).alias("_full"))
    rows = df.withColumn("win", F.floor(F.col(seq) / size).cast("int"))
    return rows.crossJoin(F.broadcast(total)).where("win < _full").drop("_full")  # one row


def slice_rows(df: DataFrame, start: int, size: int, seq: str = "seq") -> DataFrame:
    """Rows start .. start + size - 1; bounds are checked against the stream."""
    n = df.count()
    if start < 0 or size <= 0 or start + size > n:
        raise ValueError(f"rows {start}..{start + size} are not in a stream of {n}")
    return df.where(F.col(seq).between(start, start + size - 1))


def block_of_size(df: DataFrame, size: int, start: int | None = None, seed: int = 0, seq: str = "seq") -> DataFrame:
    """`size` rows from `start`, clamped into the stream; None or -1 starts at a seeded random row."""
    n = df.count()
    if start in (None, -1):
        import random

        start = random.Random(seed).randint(0, max(n - size, 0))
    start = min(max(start, 0), max(n - size, 0))
    return df.where(F.col(seq).between(start, start + size - 1))


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows that have every one of the features."""
    return df.select(*features).dropna("any")


def clamped_windows(before: int, after: int, n_windows: int) -> tuple[int, int]:
    """Two windows inside a stream of n_windows (two at least), the first before the second: indexes beyond the stream are moved to
    its ends, and a second one that does not come later to the place behind the first."""
    if n_windows < 2:
        raise ValueError("a stream of fewer than two windows has no pair")
    before = min(max(before, 0), n_windows - 2)
    return before, min(max(after, before + 1), n_windows - 1)


def pair_of_windows(df: DataFrame, before: int, after: int) -> DataFrame:
    """The rows of two windows of a windowed stream, tagged as blocks."""
    if not 0 <= before < after:
        raise ValueError("the window before must precede the window after")
    return with_blocks(df.where(F.col("win").isin(before, after)), F.col("win") == before)
