"""Windows compared with windows: class means, prototypes, distances, concepts and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftloom.sources.scratch import materialize

from .nearest import nearest
from .tiles import for_each_pair, pack, spread

CLASS_PENALTY, MEAN_PENALTY = 10.0, 2.0
#: Prototypes of a class on either side that meet in one task, and prototypes that are broadcast at once.
BLOCK, MAX_PROTOTYPES = 4_096, 65_536
#: Windows on either side whose distances one task takes.
SIDES = 512, 256
#: Windows on either side of a block of a smoothed matrix.
SMOOTH = 512


def class_distribution(windows: DataFrame) -> DataFrame:
    """Rows and percent of each class in each window (win, label)."""
    n = windows.groupBy("win", "label").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("win")))


def entropy_and_imbalance(windows: DataFrame) -> DataFrame:
    """Entropy in bits of each window's classes, and its largest class over its smallest."""
    shares = class_distribution(windows).withColumn("p", F.col("percent") / 100)
    return shares.groupBy("win").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.max("n") / F.min("n")).alias("imbalance"))


def window_composition(windows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(win, label, n, percent, prototypes): class_distribution with the number of prototypes (win, label) of each class."""
    held = prototypes.groupBy("win", "label").agg(F.count("*").alias("prototypes"))
    return class_distribution(windows).join(held, ["win", "label"], "left").fillna(0, ["prototypes"])


def window_summary(windows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(win, rows, prototypes, compression, entropy, imbalance): how many rows a window's prototypes stand for, in percent that they
    save, and how its classes are spread (see entropy_and_imbalance)."""
    sizes = window_composition(windows, prototypes).groupBy("win").agg(F.sum("n").alias("rows"), F.sum("prototypes").alias("prototypes"))
    return sizes.withColumn("compression", 100.0 * (1 - F.col("prototypes") / F.col("rows"))).join(entropy_and_imbalance(windows), "win")


def class_means(windows: DataFrame, features: list[str]) -> DataFrame:
    """Mean vector of each class in each window."""
    return windows.groupBy("win", "label").agg(F.array(*[F.avg(f) for f in features]).alias("center"))


def mean_centers(prototypes: DataFrame) -> DataFrame:
    """(win, label, center): the mean of the prototypes (win, label, center) of each class in each window."""
    means = prototypes.select("win", "label", F.posexplode("center").alias("k", "x")).groupBy("win", "label", "k").agg(F.avg("x").alias("x")).groupBy("win", "label")
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("center"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def displacement_by_class(a: DataFrame, b: DataFrame, penalty: float = CLASS_PENALTY) -> DataFrame:
    """Distance of the mean prototypes of each class (label, center); a class on one side only gets the penalty."""
    both = a.select("label", F.col("center").alias("x")).join(b.select("label", F.col("center").alias("y")), "label", "full_outer")
    return both.select("label", F.coalesce(l2(F.col("x"), F.col("y")), F.lit(penalty)).alias("distance"))


def class_matrix(first: pd.DataFrame, second: pd.DataFrame, penalty: float, matched: bool) -> np.ndarray:
    """Distances of packed windows of first (rows) and second (columns): the mean over the classes that either has of the distance
    of its centers, NaN without any. A class has one center, and costs the penalty where one is missing; matched, it has any
    number, the smaller side looks up the nearest of the larger, and each that has no partner adds the penalty."""
    both = pd.concat([first, second], ignore_index=True)
    sizes = both["labels"].map(len).to_numpy(int)
    codes, names = pd.factorize(np.concatenate([np.asarray(x, object) for x in both["labels"]] or [np.zeros(0, object)]))
    void = np.concatenate([np.asarray(x, bool) for x in both["void"]] or [np.zeros(0, bool)])
    lengths = np.array([len(f) for f in both["flat"]], int)
    dim = int(max([-(-f // max(n, 1)) for f, n in zip(lengths, sizes, strict=True)], default=1)) or 1
    values = np.concatenate([np.asarray(f, float) for f in both["flat"]] or [np.zeros(0)]).reshape(-1, dim)
    owner = np.repeat(np.arange(len(both)), sizes)
    nulls = np.bincount(owner[codes < 0], minlength=len(both)) > 0
    n = len(first)
    total, count = np.zeros((n, len(both) - n)), np.zeros((n, len(both) - n), np.int64)
    if matched:
        count += nulls[:n, None] | nulls[None, n:]
    for c in range(len(names)):
        mine = np.flatnonzero(codes == c)
        place = np.arange(len(mine)) - np.searchsorted(owner[mine], owner[mine])
        m = int(place.max()) + 1
        at, blank, held = np.full((m, len(both), dim), np.inf), np.zeros((m, len(both)), bool), np.bincount(owner[mine], minlength=len(both))
        at[place, owner[mine]], blank[place, owner[mine]] = values[mine], void[mine]
        na, nb = held[:n, None], held[None, n:]
        with np.errstate(all="ignore"):
            away = lambda i, j: np.sqrt(sum(((at[i, :n, k][:, None] - at[j, None, n:, k]) ** 2 for k in range(dim)), 0.0))  # noqa: E731, B023
            if matched:
                near = [np.full((m, *total.shape), np.inf) for _ in range(2)]
                for i in range(m):
                    for j in range(m):
                        there = (held[:n, None] > i) & (held[None, n:] > j)
                        d = np.where(there, away(i, j), np.inf)
                        near[0][i], near[1][j] = np.fmin(near[0][i], d), np.fmin(near[1][j], d)
                mean = lambda x, k: np.where(np.arange(m)[:, None, None] < k, x, 0.0).sum(0) / np.maximum(k, 1)  # noqa: E731, B023
                d = np.where(np.minimum(na, nb) > 0, np.where(na <= nb, mean(near[0], na), mean(near[1], nb)), 0.0) + penalty * np.abs(na - nb)
            else:
                d = np.where((na > 0) & (nb > 0) & ~blank[0, :n, None] & ~blank[0, None, n:], away(0, 0), penalty)
        some = (na > 0) | (nb > 0)
        total += np.where(some, d, 0.0)
        count += some
    return np.divide(total, count, out=np.full_like(total, np.nan), where=count > 0)


def class_distances(first: pd.DataFrame, second: pd.DataFrame, penalty: float, matched: bool) -> pd.DataFrame:
    """(win_a, win_b, distance) of packed windows of first that come before those of second: see class_matrix."""
    found, one, two = class_matrix(first, second, penalty, matched), first["win"].to_numpy(), second["win"].to_numpy()
    i, j = np.nonzero(~np.isnan(found) & (one[:, None] < two))
    return pd.DataFrame({"win_a": one[i], "win_b": two[j], "distance": found[i, j]})


def window_distances(centers: DataFrame, penalty: float = MEAN_PENALTY, pairs: DataFrame | None = None) -> DataFrame:
    """Mean centroid displacement of all pairs of windows win_a < win_b (or the given pairs), over the classes that either has.

    The stream's windows, not its rows, are paired: (win, label, center) holds one row for each window and class.
    """
    if pairs is None:
        sets = materialize(pack(centers.where("label is not null")), "window-centers")
        win = centers.schema["win"].dataType.simpleString()
        measure = lambda a, b: class_distances(a, b, penalty, False)
        return for_each_pair(sets, sets, measure, f"win_a {win}, win_b {win}, distance double", SIDES)
    labels = centers.select("label").distinct()
    side = lambda s, c: centers.select(F.col("win").alias(f"win_{s}"), "label", F.col("center").alias(c))
    cells = pairs.join(F.broadcast(labels)).join(side("a", "x"), ["win_a", "label"], "left").join(side("b", "y"), ["win_b", "label"], "left").where("x is not null or y is not null")
    return cells.groupBy("win_a", "win_b").agg(F.avg(F.coalesce(l2(F.col("x"), F.col("y")), F.lit(penalty))).alias("distance"))


def full_matrix(distances: DataFrame, n: int) -> DataFrame:
    """Both triangles and the zero diagonal of windows 0 .. n - 1, as (i, j, value)."""
    cell = lambda i, j: F.struct(F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), F.col("distance").alias("value"))
    both = distances.select(F.explode(F.array(cell("win_a", "win_b"), cell("win_b", "win_a"))).alias("c")).select("c.*")  # distances are taken once
    diagonal = distances.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0.0).alias("value"))
    return both.unionAll(diagonal)


def _median(around: np.ndarray) -> np.ndarray:
    """Median along the first axis of what is a number."""
    if not np.isnan(around).any() and len(around) % 2:
        return np.partition(around, len(around) // 2, 0)[len(around) // 2]
    ranked, held = np.sort(around, 0), (~np.isnan(around)).sum(0)
    at = lambda k: np.take_along_axis(ranked, np.maximum(k, 0)[None], 0)[0]
    return (at((held - 1) // 2) + at(held // 2)) / 2


def smoothed_matrix(centers: DataFrame, n: int, kernel: int, penalty: float = MEAN_PENALTY) -> DataFrame:
    """(i, j, smooth): the full matrix of window_distances of windows 0 .. n - 1 (win, label, center), smoothed by the median of
    the kernel x kernel cells around, indexes clamped to the matrix. Windows without centers have their diagonal only.

    Blocks of windows, each with those next to it, meet in tasks that take the distances and smooth them, so no cell is sent.
    """
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half, side, last = kernel // 2, SMOOTH, max(-(-n // SMOOTH) - 1, 0)
    packed = pack(centers.where("label is not null")).withColumn("win", F.col("win").cast("int"))
    sets = materialize(centers.sparkSession.range(n).select(F.col("id").cast("int").alias("win")).join(packed, "win", "left"), "window-centers")
    block = lambda shift: F.floor(F.least(F.greatest(F.col("win") + shift, F.lit(0)), F.lit(n - 1)) / side).cast("int")
    near = sets.withColumn("x", F.explode(F.sequence(block(-half), block(half))))  # a window and those that it is next to
    first = near.withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(last))))
    second = near.select(*[F.col(c).alias(f"{c}_b") for c in sets.columns], F.col("x").alias("v")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("v"))))

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[0]), int(key[1])
        b = b.rename(columns=lambda c: c.removesuffix("_b"))
        a, b = a.sort_values("win", ignore_index=True), b.sort_values("win", ignore_index=True)
        cells = np.full((len(a), len(b)), np.nan)
        i, j = (np.flatnonzero(side["labels"].notna()) for side in (a, b))
        if len(i) and len(j):
            cells[np.ix_(i, j)] = class_matrix(a.iloc[i], b.iloc[j], penalty, False)
        cells[a["win"].to_numpy()[:, None] == b["win"].to_numpy()] = 0.0
        rows, columns = np.arange(x * side, min((x + 1) * side, n)), np.arange(y * side, min((y + 1) * side, n))
        at = lambda k, of: np.searchsorted(of["win"].to_numpy(), np.clip(np.arange(k[0] - half, k[-1] + half + 1), 0, n - 1))
        wide = cells[np.ix_(at(rows, a), at(columns, b))]
        around = np.stack([wide[di : di + len(rows), dj : dj + len(columns)] for di in range(kernel) for dj in range(kernel)])
        own = ~np.isnan(around[len(around) // 2])
        smooth = _median(around)[own]
        i, j = (np.broadcast_to(k, own.shape)[own].astype(np.int32) for k in (rows[:, None], columns))
        if x < y:
            i, j, smooth = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(smooth, 2)
        return pd.DataFrame({"i": i, "j": j, "smooth": smooth})

    tiles = (last + 1) * (last + 2) // 2
    first, second = spread(first, tiles, "x", "y"), spread(second, tiles, "u", "v")
    return first.groupBy("x", "y").cogroup(second.groupBy("u", "v")).applyInPandas(tile, "i int, j int, smooth double")


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Mean, population deviation and maximum over the whole square, its diagonal included."""
    return matrix.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"))


def threshold_sweep(distances: DataFrame, concepts: DataFrame, steps: int = 200, step: float = 0.005) -> DataFrame:
    """Rates of calling two windows different when their distance exceeds a threshold, for each threshold.

    concepts: (win, concept). Neighbouring windows are left out; equality with the threshold is wrong for both kinds.
    """
    side = lambda s: concepts.select(F.col("win").alias(f"win_{s}"), F.col("concept").alias(f"c_{s}"))
    pairs = distances.where("win_b - win_a > 1").join(side("a"), "win_a").join(side("b"), "win_b").select("distance", (F.col("c_a") != F.col("c_b")).alias("differ"))
    # a distance lies above the thresholds before place `over`, and on or above those before place `met`
    near = F.array(*[F.floor(F.col("distance") / step) + d for d in (-1, 0, 1, 2)])
    places = lambda test: F.greatest(F.least(F.array_max(F.filter(near, test)) + 1, F.lit(steps)), F.lit(0))
    placed = pairs.select("differ", F.coalesce(places(lambda k: k * step < F.col("distance")), F.lit(0)).alias("over"), F.coalesce(places(lambda k: k * step <= F.col("distance")), F.lit(0)).alias("met"))
    counts = placed.groupBy("differ", "over", "met").count()  # at most a few rows for each threshold
    thresholds = distances.sparkSession.range(steps).select(F.col("id"), (F.col("id") * step).alias("threshold"))
    cells = counts.crossJoin(F.broadcast(thresholds))
    over, met = F.col("id") < F.col("over"), F.col("id") < F.col("met")
    count = lambda c: F.sum(F.when(c, F.col("count")).otherwise(F.lit(0)))
    rates = cells.groupBy("threshold").agg(
        count(F.col("differ") & over).alias("tp"), count(F.col("differ") & ~over).alias("fn"),
        count(~F.col("differ") & ~met).alias("tn"), count(~F.col("differ") & met).alias("fp"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    rates = rates.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest_prototype(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(row_id, label, proto_id, proto_class, distance): the nearest prototype (proto_id, class, center) for each row; ties go to
    the lowest id. Of prototypes at one place only the lowest id counts. They are broadcast in blocks of about
    MAX_PROTOTYPES; rows are read once for each block and joined only where there are several."""
    spark = rows.sparkSession
    at_place = prototypes.groupBy("center").agg(F.min(F.struct("proto_id", "class")).alias("p"))
    distinct = materialize(at_place.select("p.proto_id", "p.class", "center"), "prototypes")
    blocks = max(1, -(-distinct.count() // MAX_PROTOTYPES))
    kinds, out = dict(rows.dtypes) | dict(distinct.dtypes), None
    for b in range(blocks):
        listed = distinct.where(F.pmod(F.xxhash64("proto_id"), F.lit(blocks)) == b).toPandas().sort_values("proto_id", ignore_index=True)
        if not len(listed):
            continue
        sent = spark.sparkContext.broadcast((listed["proto_id"].to_numpy(), listed["class"].to_numpy(), listed["center"].tolist()))

        def assign(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, classes, centers = sent.value
            known = np.array([c is not None for c in centers])
            places, targets = np.flatnonzero(known), np.array([c for c in centers if c is not None], float)
            for pdf in batches:
                has = pdf["center"].notna().to_numpy()
                place, distance = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.nan)
                if known.all() and has.any():
                    at, distance[has] = nearest(np.stack(pdf["center"][has].to_list()).astype(float), targets)
                    place[has] = places[at]
                elif not known.all():  # without coordinates a distance is null, which comes first
                    place[:] = np.where(has, np.flatnonzero(~known)[0], 0)
                yield pd.DataFrame({"row_id": pdf["row_id"], "label": pdf["label"], "proto_id": ids[place], "proto_class": classes[place], "distance": distance})

        part = rows.select("row_id", "label", "center").mapInPandas(assign, f"row_id {kinds['row_id']}, label {kinds['label']}, proto_id {kinds['proto_id']}, proto_class {kinds['class']}, distance double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        found = rows.select("row_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("proto_id", kinds["proto_id"]), ("proto_class", kinds["class"]), ("distance", "double"))])
    elif blocks > 1:
        best = out.groupBy("row_id").agg(F.min(F.struct("distance", "proto_id", "proto_class", "label")).alias("b"))
        found = best.select("row_id", "b.label", "b.proto_id", "b.proto_class", "b.distance")
    else:
        found = out
    return found


def coverage(assigned: DataFrame) -> DataFrame:
    """For each prototype the rows of its own class that it is nearest to, and their share of the class."""
    size = assigned.groupBy("label").agg(F.count("*").alias("size"))
    own = assigned.where("label = proto_class").groupBy("label", "proto_id").agg(F.count("*").alias("covered"))
    return own.join(size, "label").select("label", "proto_id", "covered", (F.col("covered") / F.col("size")).alias("share"))


def minimal_distance(a: DataFrame, b: DataFrame, penalty: float = MEAN_PENALTY) -> DataFrame:
    """By class, the mean distance of each prototype of the smaller side to its nearest on the larger side, plus the
    penalty for each that the larger side has more; prototypes are (class, proto_id, center).

    Of each class only the smaller side asks. Both sides are cut into blocks of about BLOCK; two blocks meet in one task, which
    returns a row for each that asks. Places that the larger side has several times count once.
    """
    na, nb = (x.groupBy("class").agg(F.count("*").alias(f"n_{s}")) for x, s in ((a, "a"), (b, "b")))
    sizes = materialize(na.join(nb, "class", "full_outer").fillna(0, ["n_a", "n_b"]), "sizes")
    both = a.withColumn("_side", F.lit("a")).unionByName(b.withColumn("_side", F.lit("b")), allowMissingColumns=True).where("center is not null").join(sizes, "class")
    few = (F.col("_side") == "a") == (F.col("n_a") <= F.col("n_b"))
    blocks = lambda n: F.ceil(F.greatest(n("n_a", "n_b"), F.lit(1)) / BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    asks = both.where(few).select("class", "proto_id", "center", F.pmod(F.xxhash64("proto_id"), blocks(F.least)).alias("x"), spread(F.greatest).alias("y"))
    places = both.where(~few).select("class", "center", blocks(F.greatest).alias("_n"), F.col("n_a"), F.col("n_b")).distinct()
    asked = places.select(F.col("class").alias("c"), F.col("center").alias("at"), F.pmod(F.xxhash64("center"), F.col("_n")).alias("v"), spread(F.least).alias("u"))

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = nearest(np.stack(x["center"].to_list()).astype(float), np.stack(y["at"].to_list()).astype(float))[1] if len(x) and len(y) else np.zeros(0)
        few = x.iloc[: len(d)]
        return pd.DataFrame({"class": few["class"], "proto_id": few["proto_id"], "d": d})

    kinds = dict(asks.dtypes)
    each = asks.groupBy("class", "x", "y").cogroup(asked.groupBy("c", "u", "v")).applyInPandas(near, f"class {kinds['class']}, proto_id {kinds['proto_id']}, d double")
    means = each.groupBy("class", "proto_id").agg(F.min("d").alias("d")).groupBy("class").agg(F.avg("d").alias("mean"))
    cells = sizes.join(means, "class", "left")
    return cells.select("class", (F.coalesce("mean", F.lit(0.0)) + penalty * F.abs(F.col("n_a") - F.col("n_b"))).alias("distance"))


def contingency(assigned: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return assigned.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """Adjusted Rand index, Fowlkes-Mallows, completeness and mutual information (nats) of a contingency table (u, v, n)."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    xlx = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    cells = table.agg(F.sum(two("n")).alias("pairs"), F.sum(xlx("n")).alias("h_uv"), F.sum("n").alias("total"))
    margin = lambda k, s: table.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias(f"pairs_{s}"), F.sum(xlx("m")).alias(f"h_{s}"))
    t = cells.crossJoin(margin("u", "u")).crossJoin(margin("v", "v"))  # one row each
    all_ = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("pairs_u") * F.col("pairs_v") / all_
    half = (F.col("pairs_u") + F.col("pairs_v")) / 2
    n = F.col("total")
    entropy_v = F.log(n) - F.col("h_v") / n
    mutual = F.log(n) + (F.col("h_uv") - F.col("h_u") - F.col("h_v")) / n
    return t.select(
        F.when(half != expected, (F.col("pairs") - expected) / (half - expected)).otherwise(F.lit(1.0)).alias("adjusted_rand"),
        F.when(F.col("pairs") > 0, F.col("pairs") / F.sqrt(F.col("pairs_u") * F.col("pairs_v"))).otherwise(F.lit(0.0)).alias("fowlkes_mallows"),
        F.when(entropy_v > 1e-12, mutual / entropy_v).otherwise(F.lit(1.0)).alias("completeness"), mutual.alias("mutual_information"),
    )


def block_metric_flags(metric: DataFrame, grace: int, sigmas: float = 3.0) -> DataFrame:
    """(win, value, drift): a block drifts if its metric lies beyond mean +- sigmas * population deviation of the metric in
    iterations grace / 2 up to grace; earlier ones never do. The reference is not learnt anew after a detection."""
    reference = metric.where(F.col("win").between(grace // 2, grace - 1)).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    rows = metric.crossJoin(F.broadcast(reference))  # one row
    beyond = (F.col("value") > F.col("mu") + sigmas * F.col("sd")) | (F.col("value") < F.col("mu") - sigmas * F.col("sd"))
    return rows.select("win", "value", ((F.col("win") >= grace) & beyond).alias("drift"))


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """Mutual information of a contingency table (u, v, n) above its expectation for the same margins, as a share of the mean
    entropy above that expectation.

    A pair of margins (a, b) adds the hypergeometric mean of its term; only counts within 40 deviations of the expected one
    are summed, beyond which terms vanish in double precision. The table of margins is as small as the sets of groups.
    """

    def expected(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        log_factorial = lambda xs: np.array([lgamma(x + 1) for x in xs])
        out = []
        for x, y, t in zip(a, b, n, strict=True):
            mean = x * y / t
            sd = sqrt(max(mean * (t - x) * (t - y) / (t * max(t - 1, 1)), 0)) + 1
            k = np.arange(max(1, x + y - t, int(mean - 40 * sd)), min(x, y, int(mean + 40 * sd) + 1) + 1)
            logs = sum(lgamma(z + 1) for z in (x, y, t - x, t - y)) - lgamma(t + 1) - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(t - x - y + k)
            out.append(float((k / t * np.log(t * k / (x * y)) * np.exp(logs)).sum()))
        return pd.Series(out)

    n = table.agg(F.sum("n").alias("t"))
    margin = lambda k, name: table.groupBy(k).agg(F.sum("n").alias(name)).select(name)
    cells = margin("u", "a").crossJoin(margin("v", "b")).crossJoin(F.broadcast(n))  # groups x groups
    by_chance = cells.agg(F.sum(pandas_udf(expected, "double")(F.col("a"), F.col("b"), F.col("t"))).alias("emi"))
    entropy = lambda k, name: table.groupBy(k).agg(F.sum("n").alias("m")).crossJoin(F.broadcast(n)).agg((-F.sum(F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t")))).alias(name))
    rows = agreement(table).select("mutual_information").crossJoin(by_chance).crossJoin(entropy("u", "hu")).crossJoin(entropy("v", "hv"))  # one row each
    room = (F.col("hu") + F.col("hv")) / 2 - F.col("emi")
    return rows.select(F.when(F.abs(room) > 1e-12, (F.col("mutual_information") - F.col("emi")) / room).otherwise(F.lit(1.0)).alias("adjusted_mutual_information"))
