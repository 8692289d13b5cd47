"""Values of scattered points as a smooth field over a plane."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .ordered import quantiles

#: Most buckets along a side of the index, and points that a bucket should hold on average.
MAX_SIDE, PER_BUCKET = 1024, 4


def grid_points(points: DataFrame, size: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """size x size cells (i, j, u, v) between the `low` and `high` quantiles of the points' u and v."""
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("value")) for c in ("u", "v")])).alias("p")).select("p.*")
    ends = {r.axis: (r.lo, r.hi) for r in quantiles(long, ["axis"], {"lo": low, "hi": high}).collect()}
    place = lambda axis, k: F.lit(ends[axis][0]) + k * F.lit(ends[axis][1] - ends[axis][0]) / (size - 1)
    cells = points.sparkSession.range(size * size).select((F.col("id") % size).cast("int").alias("i"), F.floor(F.col("id") / size).cast("int").alias("j"))
    return cells.select("i", "j", place("u", F.col("i")).alias("u"), place("v", F.col("j")).alias("v"))


def _radii(counts: np.ndarray, k: int, diagonal: float) -> np.ndarray:
    """For each bucket a radius that holds the k nearest points of every place in it (or all, if there are fewer)."""
    rows, columns = counts.shape
    total = np.zeros((rows + 1, columns + 1), np.int64)
    total[1:, 1:] = counts.cumsum(0).cumsum(1)
    a, b = np.arange(rows)[:, None], np.arange(columns)[None]

    def around(r: np.ndarray) -> np.ndarray:
        top, bottom = np.maximum(a - r, 0), np.minimum(a + r + 1, rows)
        left, right = np.maximum(b - r, 0), np.minimum(b + r + 1, columns)
        return total[bottom, right] - total[top, right] - total[bottom, left] + total[top, left]

    low, high = np.full(counts.shape, -1), np.full(counts.shape, max(rows, columns))
    while (open_ := high - low > 1).any():  # the fewest rings of buckets with k points, for all buckets at once
        mid = (low + high) // 2
        enough = around(mid) >= k
        high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid, low)
    return (high + 1) * diagonal


def nearest_points(cells: DataFrame, points: DataFrame, k: int = 10, per_bucket: int = PER_BUCKET) -> DataFrame:
    """The k nearest points of each cell (i, j, u, v), one row for each: i, j, place (from 1), d2 (squared distance) and the
    points' columns besides u and v. Points are (row_id, u, v, ...). Ties go to the lower row_id; fewer points than k are all.

    Points lie in the buckets of a lattice, about per_bucket in each. Only the number of points in each bucket (MAX_SIDE
    squared at most) comes to the driver, where rings of buckets around each are widened until they hold k points. A cell
    then meets the points of the buckets within that reach, by an equi-join: what it meets depends on k, not on the number
    of points, as long as no bucket is crowded. Points without coordinates are never near.
    """
    points = materialize(points.where("u is not null and v is not null"), "points")
    n, *ends = points.agg(F.count("*"), F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    u0, u1, v0, v1 = ends if n else (0.0, 1.0, 0.0, 1.0)
    wide, high = (u1 - u0) or 1.0, (v1 - v0) or 1.0
    side = lambda span, other: max(1, min(MAX_SIDE, round(math.sqrt(n / per_bucket * span / other))))
    rows, columns = side(wide, high), side(high, wide)
    width, height = wide / rows, high / columns
    bucket = lambda c, lo, w, n: F.least(F.greatest(F.floor((F.col(c) - lo) / w), F.lit(0)), F.lit(n - 1)).cast("int")
    in_bucket = {"_a": bucket("u", u0, width, rows), "_b": bucket("v", v0, height, columns)}
    placed = points.withColumns(in_bucket)
    counts = np.zeros((rows, columns), np.int64)
    for r in placed.groupBy("_a", "_b").count().collect():
        counts[r["_a"], r["_b"]] = r["count"]
    radii = _radii(counts, k, math.hypot(width, height))
    wanted = points.sparkSession.createDataFrame([(a, b, float(radii[a, b])) for a in range(rows) for b in range(columns)], "_a int, _b int, _radius double")
    # a cell beyond the points is measured from the bucket at the edge
    beyond = lambda c, lo, hi: F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0))
    asking = cells.withColumns(in_bucket).join(F.broadcast(wanted), ["_a", "_b"]).withColumn("_radius", F.col("_radius") + beyond("u", u0, u1) + beyond("v", v0, v1))
    reach = lambda c, w, n: F.sequence(F.greatest(F.col(c) - F.ceil(F.col("_radius") / w), F.lit(0)).cast("int"), F.least(F.col(c) + F.ceil(F.col("_radius") / w), F.lit(n - 1)).cast("int"))
    asking = asking.withColumn("_x", F.explode(reach("_a", width, rows))).withColumn("_y", F.explode(reach("_b", height, columns)))
    asking = asking.select("i", "j", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("_x").alias("_a"), F.col("_y").alias("_b"))
    du, dv = F.col("u") - F.col("_u"), F.col("v") - F.col("_v")
    near = asking.join(placed, ["_a", "_b"]).withColumn("d2", du * du + dv * dv)
    place = F.row_number().over(Window.partitionBy("i", "j").orderBy("d2", "row_id"))
    return near.withColumn("place", place).where(F.col("place") <= k).drop("_a", "_b", "_u", "_v", "u", "v")


def distance_weighted(near: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, names) of nearest_points: means weighted by one over the distance; points at the cell itself count alone."""
    weight = F.when(F.col("_least") == 0, (F.col("d2") == 0).cast("double")).otherwise(1 / F.sqrt("d2"))
    rows = near.withColumn("_least", F.min("d2").over(Window.partitionBy("i", "j"))).withColumn("_w", weight)
    return rows.groupBy("i", "j").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in names])


def smoothed(field: DataFrame, names: Sequence[str], size: int, sigma: float = 0.6) -> DataFrame:
    """A field (i, j, names) on size x size cells under a Gaussian of sigma cells, cut at 4 sigma and mirrored at the edges.

    The Gaussian is separable: first cells along i meet, then along j, each as a sum of shifted copies of the cells.
    """
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    steps = field.sparkSession.createDataFrame([(d, float(w)) for d, w in zip(range(-radius, radius + 1), kernel / kernel.sum(), strict=True)], "_d int, _w double")
    for axis, other in (("i", "j"), ("j", "i")):
        at = F.pmod(F.col("_to") + F.col("_d"), F.lit(2 * size))
        wanted = field.sparkSession.range(size).select(F.col("id").cast("int").alias("_to")).crossJoin(steps)  # size x stencil rows
        wanted = wanted.select("_to", "_w", F.when(at < size, at).otherwise(2 * size - 1 - at).alias(axis))
        met = field.join(F.broadcast(wanted), axis)
        field = met.groupBy(F.col("_to").alias(axis), other).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in names])
    return field


def interpolate(points: DataFrame, names: Sequence[str], size: int = 200, k: int = 10, sigma: float = 0.6) -> DataFrame:
    """(i, j, u, v, names): columns of points (row_id, u, v, names), such as labels and confidences, as a field between the 1st
    and 99th percentile of both coordinates: means of the k nearest points by distance, smoothed, within [0, 1].

    Null coordinates are left out; no points give no field.
    """
    points = points.where("u is not null and v is not null")
    if not points.limit(1).count():
        return points.sparkSession.createDataFrame([], "i int, j int, u double, v double, " + ", ".join(f"{c} double" for c in names))
    cells = materialize(grid_points(points, size), "cells")
    field = smoothed(distance_weighted(nearest_points(cells, points, k), names), names, size, sigma)
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)).alias(c)
    return cells.join(field, ["i", "j"]).select("i", "j", "u", "v", *[clip(c) for c in names])
