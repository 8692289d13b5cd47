"""Tables that summarise drift analyses: streams, prototypes, clusters, matched labels, neighbours, drift reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .clusters import assignment
from .ordered import by_value, null_safe_join, numbered
from .recurrence import SIDES, class_distances, mean_centers, window_distances
from .tiles import for_each_pair, pack

#: Distinct labels that can be matched on the driver; points whose neighbours are sought in one broadcast.
MAX_MATCHED, MAX_POINTS = 2_000, 5_000
#: Points, and rows, whose distances a task holds at once.
MEET = 512


def stream_totals(windows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Rows, prototypes, mean, least, most and population deviation of prototypes in a window, and the compression in percent.

    windows: (win, ...) rows of a stream; prototypes: (win, ...). A window without prototypes counts with 0.
    """
    sizes = windows.groupBy("win").agg(F.count("*").alias("rows"))
    per = sizes.join(prototypes.groupBy("win").agg(F.count("*").alias("n")), "win", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = per.agg(
        F.sum("rows").alias("samples"), F.sum("n").alias("prototypes"), F.avg("n").alias("avg_per_window"), F.min("n").alias("min_per_window"),
        F.max("n").alias("max_per_window"), F.stddev_pop("n").alias("std_per_window"),
    )
    return out.withColumn("compression", 100.0 * (1 - F.try_divide("prototypes", "samples")))


def vector_stats(rows: DataFrame, keys: Sequence[str], vector: str = "center") -> DataFrame:
    """Mean, population deviation, minimum and maximum of each coordinate (from 0) by keys."""
    long = rows.select(*keys, F.posexplode(vector).alias("feature", "value"))
    return long.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def first_of_each(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key by order."""
    return numbered(rows, [key], [order], "_place").where(F.col("_place") <= k).drop("_place")


def at_positions(rows: DataFrame, positions: Sequence[int], seq: str = "seq") -> DataFrame:
    """Rows at given positions of a numbered table, each once, in the table's order; positions outside are an error."""
    wanted = rows.sparkSession.createDataFrame([(int(p),) for p in set(positions)], f"{seq} long")
    found = rows.join(F.broadcast(wanted), seq, "left_semi")
    if found.count() < len(set(positions)):
        raise ValueError("a position is not in the table")
    return found


def of_classes(rows: DataFrame, labels: Sequence, label: str = "label") -> DataFrame:
    """Rows of the given classes."""
    return rows.where(F.col(label).isin(list(labels)))


def capped_split(rows: DataFrame, label: str, row_id: str, train_share: float = 0.9, cap: int = 5_000) -> DataFrame:
    """Adds `part`: 'train' for about min(train_share x n, cap) rows, the same share of every class, else 'test'.

    Rows of a class are taken in the order of a hash of row_id, so the choice does not depend on partitioning.
    """
    n = rows.count()
    share = min(train_share, cap / n) if n else 0.0
    keyed = rows.withColumn("_hash", F.xxhash64(row_id))
    placed = numbered(keyed, [label], ["_hash", row_id], "_place")
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    taken = F.col("_place") <= F.round(F.col("_size") * share)
    return null_safe_join(placed, sizes, [label]).withColumn("part", F.when(taken, "train").otherwise("test")).drop("_hash", "_place", "_size")


def matched_labels(table: DataFrame) -> DataFrame:
    """(v, u) of a one-to-one matching of clusters v to classes u with the most rows in a contingency table (u, v, n).

    The table of labels is checked to be small before the driver matches it. The spare ones of the longer side have no partner.
    """
    rows = table.where("u is not null and v is not null").limit(MAX_MATCHED * MAX_MATCHED + 1).collect()
    us, vs = sorted({r.u for r in rows}), sorted({r.v for r in rows})
    if max(len(us), len(vs)) > MAX_MATCHED:
        raise ValueError(f"more than {MAX_MATCHED} labels to match")
    gain = np.zeros((len(us), len(vs)))
    for r in rows:
        gain[us.index(r.u), vs.index(r.v)] = r.n
    pairs = [(vs[j], us[i]) for i, j in assignment(gain.max(initial=0) - gain)] if rows else []
    kinds = dict(table.dtypes)
    return table.sparkSession.createDataFrame(pairs, f"v {kinds['v']}, u {kinds['u']}")


def clustering_accuracy(assigned: DataFrame, truth: str, cluster: str, outlier=None) -> DataFrame:
    """Share of rows whose cluster is matched to their class, over the rows that are not outliers, and the same with
    outliers counted as wrong."""
    is_out = F.col(cluster).eqNullSafe(F.lit(outlier)) if outlier is not None else F.lit(False)
    inner = assigned.where(~is_out)
    table = inner.groupBy(F.col(truth).alias("u"), F.col(cluster).alias("v")).agg(F.count("*").alias("n"))
    hits = table.join(F.broadcast(matched_labels(table)), ["u", "v"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    sizes = assigned.agg(F.count("*").alias("rows"), F.sum(is_out.cast("long")).alias("outliers"))
    both = sizes.crossJoin(hits)  # one row each
    accuracy = F.coalesce(F.try_divide(F.col("hits"), F.col("rows") - F.col("outliers")), F.lit(0.0))
    return both.select("rows", "outliers", accuracy.alias("accuracy"), (accuracy * (1 - F.col("outliers") / F.col("rows"))).alias("accuracy_with_outliers"))


def _keep_nearest(best: tuple[np.ndarray, np.ndarray, np.ndarray], centers: np.ndarray, x: np.ndarray, row_ids: np.ndarray) -> None:
    """Merges rows x into the (distance, row_id, there) of the nearest of each center so far; MEET centers at a time meet all of x."""
    k = best[0].shape[1]
    for i in range(0, len(centers), MEET):
        some = slice(i, min(i + MEET, len(centers)))
        total = np.zeros((some.stop - i, len(x)))
        for c in range(x.shape[1]):
            d = x[:, c] - centers[some, c, None]
            d *= d
            total += d
        bar = best[0][some, -1]  # squares of distances up to the bar lie within a rounding of its square
        point, row = np.nonzero(total <= (bar * bar * (1 + 1e-12))[:, None]) if np.isfinite(bar).all() else np.nonzero(total <= np.partition(total, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1, None] * (1 + 1e-12))
        if not len(point):
            continue
        hit = np.unique(point)
        old, at = np.nonzero(best[2][some][hit])
        owner = np.r_[point, hit[old]]
        distance = np.r_[np.sqrt(total[point, row]), best[0][some][hit][old, at]]
        rid = np.r_[row_ids[row], best[1][some][hit][old, at]]
        order = np.lexsort((rid, distance, owner))
        owner, distance, rid = owner[order], distance[order], rid[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < k
        for kept, values in zip(best, (distance, rid, np.ones(len(rid), bool)), strict=True):
            kept[i + owner[keep], place[keep]] = values[keep]


def nearest_rows(points: DataFrame, rows: DataFrame, k: int = 6) -> DataFrame:
    """(point_id, row_id, place, distance): the k rows nearest to each point, ties to the lower row_id.

    points: (point_id, center), rows: (row_id, center). Points are broadcast in blocks of MAX_POINTS; each task keeps k
    rows for each point, so k rows a task and point are shuffled. Distances are held for MEET points and rows at a time.
    """
    spark, out = points.sparkSession, None
    n = points.count()
    for b in range(max(1, -(-n // MAX_POINTS))):
        block = points.where(F.pmod(F.xxhash64("point_id"), F.lit(max(1, -(-n // MAX_POINTS)))) == b).collect()
        sent = spark.sparkContext.broadcast((np.array([p.point_id for p in block]), np.array([p.center for p in block], float)))

        def nearest(batches, sent=sent):
            ids, centers = sent.value
            best = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k), bool)
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                x = np.stack([np.asarray(c, float) for c in pdf["center"]])
                for i in range(0, len(x), MEET):
                    _keep_nearest(best, centers, x[i : i + MEET], pdf["row_id"].to_numpy()[i : i + MEET])
            point, place = np.nonzero(best[2])
            yield pd.DataFrame({"point_id": ids[point], "row_id": best[1][point, place], "distance": best[0][point, place]})

        kinds = dict(points.dtypes) | dict(rows.dtypes)
        part = rows.select("row_id", "center").mapInPandas(nearest, f"point_id {kinds['point_id']}, row_id {kinds['row_id']}, distance double")
        out = part if out is None else out.unionAll(part)
    place = F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "row_id"))  # k rows for each task
    return out.withColumn("place", place).where(F.col("place") <= k).select("point_id", "row_id", "place", "distance")


def joint_histogram(long: DataFrame, bins: int = 30) -> DataFrame:
    """Density of each block in equal bins over the joint range of both, by class and feature; empty bins are left out."""
    keys = ["label", "feature"]
    ranges = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    binned = null_safe_join(long, ranges, keys).withColumn("width", width)
    binned = binned.withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*keys, "block", "bin").agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.max("width").alias("width"))
    total = F.sum("n").over(Window.partitionBy(*keys, "block"))  # a row for each bin
    return counts.select(*keys, "block", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), (F.col("n") / total / F.col("width")).alias("density"))


def quantile_pairs(long: DataFrame, points: int = 100) -> DataFrame:
    """Quantiles of both blocks at shares (i + 0.5) / points by class and feature: the value whose running count first
    reaches the share."""
    counts = long.where("value is not null").groupBy("label", "feature", "block", "value").agg(F.count("*").alias("c"))
    placed = by_value(counts, ["label", "feature", "block"], {"c": "c"})
    low, high = (F.col("run_c") - F.col("c")) / F.col("all_c"), F.col("run_c") / F.col("all_c")
    i = F.sequence(F.greatest(F.floor(low * points - 0.5) - 1, F.lit(0)), F.least(F.ceil(high * points - 0.5) + 1, F.lit(points - 1)))
    share = lambda x: (x + 0.5) / points
    at = placed.withColumn("i", F.explode(F.filter(i, lambda x: (share(x) > low) & (share(x) <= high))))
    side = lambda b: F.max(F.when(F.col("block") == b, F.col("value"))).alias(b)
    return at.groupBy("label", "feature", "i").agg(side("before"), side("after"))


def ranking(rows: DataFrame, score: str, ties: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds `place` from 1, the largest score first. Rows are items of a report: features, rules, prototypes."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *ties)
    return rows.withColumn("place", F.row_number().over(order))


def _percent(x: Column) -> Column:
    return F.format_string("%.2f%%", 100 * x)


def stat_shift_table(stats: DataFrame) -> DataFrame:
    """A row for each class and cluster with the shift of each feature and statistic in percent, 'N/A' where one is missing."""
    cells = stats.select("label", "cluster", F.concat_ws(" | ", "feature", "stat").alias("cell"), F.coalesce(_percent(F.col("shift")), F.lit("N/A")).alias("text"))
    return cells.groupBy("label", "cluster").pivot("cell").agg(F.first("text")).fillna("N/A")


def centroid_listing(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """Coordinates of each cluster's mean in both blocks as text with 4 digits, '-' where a block has none."""
    means = assigned.unpivot(["label", "cluster", "block"], list(features), "feature", "value").groupBy("label", "cluster", "feature")
    wide = means.pivot("block", ["before", "after"]).agg(F.avg("value"))
    text = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("-")).alias(c)
    return wide.select("label", "cluster", "feature", text("before"), text("after"))


def distance_report(shifts: DataFrame) -> DataFrame:
    """Signed change of the mean distance to the centre in percent, 'N/A' without a counterpart."""
    sign = F.when(F.col("shift") > 0, "+").otherwise("")
    return shifts.select("label", "cluster", F.coalesce(F.concat(sign, _percent(F.col("shift"))), F.lit("N/A")).alias("change"), "drift")


def criterion_contributions(criteria: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """For each class and criterion: drifting items, all items, and their share times the criterion's part of the weights.

    Each criterion is a table (label, drift) with one row an item.
    """
    total, out = sum(weights.values()), None
    for name, items in criteria.items():
        part = items.groupBy("label").agg(F.sum(F.col("drift").cast("long")).alias("drifting"), F.count("*").alias("items"))
        part = part.select("label", F.lit(name).alias("criterion"), "drifting", "items", (F.col("drifting") / F.col("items") * weights[name] / total).alias("contribution"))
        out = part if out is None else out.unionAll(part)
    return out


def drift_report(described: DataFrame, peaks: DataFrame) -> DataFrame:
    """Drifts with their end moved to the largest moving rate: rates at start and end, the rise and its percentage.

    described: (stream_id, drift, start, rate_warning, ...); peaks: (stream_id, drift, peak, rate).
    """
    rows = described.join(peaks, ["stream_id", "drift"], "left")
    start, end = F.col("rate_warning"), F.coalesce(F.col("rate"), F.col("rate_peak"))
    stop = F.coalesce(F.col("peak"), F.col("end"))
    return rows.select(
        "stream_id", "drift", "start", stop.alias("end"), (stop - F.col("start")).alias("duration"), start.alias("rate_start"), end.alias("rate_end"),
        (end - start).alias("increase"), F.when(start > 0, (end - start) / start * 100).alias("change_pct"),
    )


def window_minimal_distances(prototypes: DataFrame, penalty: float = 2.0, pairs: DataFrame | None = None) -> DataFrame:
    """Mean over classes of the minimal distance of prototypes between windows (win, label, proto_id, center).

    All pairs win_a < win_b, or the given ones (two windows, or one against all). The windows of a stream are paired, not
    its rows. Of each class the smaller side looks up the larger one; each prototype without a partner adds the penalty.
    """
    if pairs is None:
        sets = materialize(pack(prototypes), "window-prototypes")
        win = prototypes.schema["win"].dataType.simpleString()
        return for_each_pair(sets, sets, lambda a, b: class_distances(a, b, penalty, True), f"win_a {win}, win_b {win}, distance double", SIDES)
    listed = prototypes.groupBy("win", "label").agg(F.collect_list("center").alias("cs"))  # the prototypes of one class in one window
    side = lambda s: listed.select(F.col("win").alias(f"win_{s}"), "label", F.col("cs").alias(f"c_{s}"))
    classes = pairs.join(listed.select(F.col("win").alias("win_a"), "label"), "win_a").union(pairs.join(listed.select(F.col("win").alias("win_b"), "label"), "win_b").select("win_a", "win_b", "label")).distinct()
    both = classes.join(side("a"), ["win_a", "label"], "left").join(side("b"), ["win_b", "label"], "left")
    l2 = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    size = lambda s: F.coalesce(F.size(f"c_{s}"), F.lit(0))
    few = F.when(size("a") <= size("b"), F.col("c_a")).otherwise(F.col("c_b"))
    many = F.when(size("a") <= size("b"), F.col("c_b")).otherwise(F.col("c_a"))
    each = F.transform(few, lambda x: F.array_min(F.transform(many, lambda y: l2(x, y))))
    mean = F.coalesce(F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(few), F.lit(0.0))
    cells = both.withColumn("d", mean + penalty * F.abs(size("a") - size("b")))
    return cells.groupBy("win_a", "win_b").agg(F.avg("d").alias("distance"))


def compare_windows(prototypes: DataFrame, metric: str, first: int | None = None, second: int | None = None) -> DataFrame:
    """Two windows, one against all later and earlier ones, or all pairs, by `minimal_distance` or `centroid_displacement`."""
    wins = prototypes.select("win").distinct()
    if first is not None:
        others = wins.where(F.col("win") == second if second is not None else F.col("win") != first)
        pairs = others.select(F.least("win", F.lit(first)).alias("win_a"), F.greatest("win", F.lit(first)).alias("win_b"))
    else:
        pairs = None
    if metric == "minimal_distance":
        return window_minimal_distances(prototypes, pairs=pairs)
    if metric == "centroid_displacement":
        centers = mean_centers(prototypes)
        return window_distances(centers if pairs is None else materialize(centers, "centers"), pairs=pairs)
    raise ValueError(f"unknown metric: {metric}")
