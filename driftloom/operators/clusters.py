"""Clusters of each class in two blocks, how they match, and how strongly they drift."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .block_stats import group_stats

#: Rows of one class and block that fitting centres takes; all rows are then assigned to the centres.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Thresholds:
    """Thresholds of the four criteria; distances are scaled by the root of the number of features."""

    match: float = 0.5
    centroid_shift: float = 0.3
    stats_shift: float = 0.2
    distance_shift: float = 0.2
    decision: float = 0.5
    weights: tuple[float, float, float, float] = (0.4, 0.25, 0.25, 0.1)

    def __post_init__(self):
        if self.match <= self.centroid_shift:
            raise ValueError("a cluster must move further to disappear than to shift")

    def scaled(self, value: float, features: int) -> float:
        return value * math.sqrt(features)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from k-means++ seeds; empty centres stay where they are."""
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    centers = np.array(centers)
    for _ in range(rounds):
        labels = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(k)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers, labels


def _bic(x: np.ndarray, centers: np.ndarray, labels: np.ndarray) -> float:
    """Information criterion of spherical clusters with one variance."""
    n, d, k = len(x), x.shape[1], len(centers)
    if n <= k:
        return -math.inf
    variance = max(((x - centers[labels]) ** 2).sum() / (d * (n - k)), 1e-12)
    counts = np.bincount(labels, minlength=k)
    counts = counts[counts > 0]
    fit = (counts * np.log(counts)).sum() - n * math.log(n) - n * d / 2 * math.log(2 * math.pi * variance) - d * (n - k) / 2
    return fit - (k * (d + 1)) / 2 * math.log(n)


def xmeans(x: np.ndarray, k_first: int = 2, k_max: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of k-means whose clusters are split in two while the information criterion rises, up to k_max."""
    rng = np.random.default_rng(seed)
    k_first = min(k_first, len(np.unique(x, axis=0)))
    centers, labels = kmeans(x, k_first, rng)
    while len(centers) < k_max:
        grown, room = [], k_max - len(centers)
        for j in range(len(centers)):
            part = x[labels == j]
            if room and len(part) > 3 and len(np.unique(part, axis=0)) > 1:
                two, two_labels = kmeans(part, 2, rng)
                if _bic(part, two, two_labels) > _bic(part, part.mean(0, keepdims=True), np.zeros(len(part), int)):
                    grown += list(two)
                    room -= 1
                    continue
            grown.append(centers[j])
        if len(grown) == len(centers):
            break
        centers = np.array(grown)
        for _ in range(50):
            labels = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            moved = np.array([x[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(len(centers))])
            if np.allclose(moved, centers):
                break
            centers = moved
    return centers


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost one-to-one matching (shortest augmenting paths with potentials)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assignment(cost.T)]
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < best[free]
            best[free[better]], way[free[better]] = slack[better], j0
            j1 = free[best[free].argmin()]
            delta = best[j1]
            u[match[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def match_centers(before: np.ndarray, after: np.ndarray, limit: float) -> list[tuple[int | None, int | None]]:
    """Optimal pairs of centres no further apart than limit; the rest disappeared (b, None) or appeared (None, a)."""
    if not len(before) or not len(after):
        return [(i, None) for i in range(len(before))] + [(None, j) for j in range(len(after))]
    d = np.sqrt(((before[:, None] - after[None]) ** 2).sum(2))
    pairs = [(i, j) for i, j in assignment(np.where(d > limit, 1e6, d)) if d[i, j] <= limit]
    return pairs + [(i, None) for i in range(len(before)) if i not in {p[0] for p in pairs}] + [(None, j) for j in range(len(after)) if j not in {p[1] for p in pairs}]


def fit_centers(rows: DataFrame, features: list[str], k_max: int = 10, seed: int = 0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(label, block, k, center): centres of each class and block.

    A class and block with more than fit_rows rows is fitted on about that many, picked by a seeded hash of their values, so
    that another partitioning picks the same; a task holds a bounded number of rows whatever the class's size.
    """
    sizes = rows.groupBy("label", "block").agg(F.count("*").alias("_n"))
    some = rows.join(F.broadcast(sizes), ["label", "block"]).where(F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1_000_003)) * F.col("_n") < F.lit(1_000_003.0 * fit_rows))
    label_type = rows.schema["label"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        centers = xmeans(pdf.sort_values(features)[features].to_numpy(float), k_max=k_max, seed=seed)
        centers = centers[np.lexsort(centers.T[::-1])]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "block": pdf["block"].iloc[0], "k": range(len(centers)), "center": [c.tolist() for c in centers]})

    return some.select("label", "block", *features).groupBy("label", "block").applyInPandas(fit, f"label {label_type}, block string, k int, center array<double>")


def global_ids(centers: DataFrame, limit: float) -> DataFrame:
    """Adds `cluster`, one number for a matched pair of centres of a class, and status; numbers of clusters that appeared
    follow all others. There are at most k_max centres for each class and block."""
    label_type = centers.schema["label"].dataType.simpleString()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {b: g.sort_values("k") for b, g in pdf.groupby("block")}
        arrays = {b: np.array(side[b]["center"].tolist()) if b in side else np.zeros((0, 1)) for b in ("before", "after")}
        out = []
        for local, (i, j) in enumerate(match_centers(arrays["before"], arrays["after"], limit)):
            status = "matched" if i is not None and j is not None else "disappeared" if j is None else "appeared"
            for b, k in (("before", i), ("after", j)):
                if k is not None:
                    out.append((pdf["label"].iloc[0], b, int(side[b]["k"].iloc[k]), side[b]["center"].iloc[k], local, status))
        return pd.DataFrame(out, columns=["label", "block", "k", "center", "local", "status"])

    matched = centers.groupBy("label").applyInPandas(match, f"label {label_type}, block string, k int, center array<double>, local int, status string")
    number = F.dense_rank().over(Window.orderBy(F.col("status") == "appeared", "label", "local")) - 1  # a few rows for each class
    return matched.select("label", "block", "k", "center", number.cast("int").alias("cluster"), "status")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def assign(rows: DataFrame, centers: DataFrame, features: list[str]) -> DataFrame:
    """Every row with the cluster of its nearest centre of its class and block, and the distance to it."""
    listed = centers.groupBy("label", "block").agg(F.collect_list(F.struct("cluster", "center")).alias("cs"))  # k_max centres at most
    near = F.array_min(F.transform("cs", lambda c: F.struct(distance(F.array(*features), c["center"]).alias("d"), c["cluster"].alias("cluster"))))
    return rows.join(F.broadcast(listed), ["label", "block"]).withColumn("near", near).select(*rows.columns, F.col("near.cluster").alias("cluster"), F.col("near.d").alias("distance"))


def cluster_stats(assigned: DataFrame, features: list[str]) -> DataFrame:
    """Median, mean and sample deviation of each feature by class, cluster and block, with the shift between blocks.

    The shift is relative to |before| (or absolute where that is below 1e-10) and NULL where a side is missing.
    """
    long = assigned.unpivot(["label", "cluster", "block"], features, "feature", "value")
    cells = group_stats(long, ["label", "cluster", "block", "feature"])
    side = lambda b: [F.max(F.when(F.col("block") == b, F.col(s))).alias(f"{b}_{s}") for s in ("median", "mean", "std")]
    stats = cells.groupBy("label", "cluster", "feature").agg(*side("before"), *side("after"))
    stat = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"before_{s}").alias("before"), F.col(f"after_{s}").alias("after")) for s in ("median", "mean", "std")]))
    rows = stats.select("label", "cluster", "feature", stat.alias("s")).select("label", "cluster", "feature", "s.*")
    base = F.when(F.abs("before") < 1e-10, F.lit(1.0)).otherwise(F.abs("before"))
    return rows.withColumn("shift", (F.col("after") - F.col("before")) / base)


def flag_stats(stats: DataFrame, threshold: float = 0.2) -> DataFrame:
    """A missing shift counts as drift."""
    return stats.withColumn("drift", F.coalesce(F.abs("shift") > threshold, F.lit(True)))


def centroid_shift(assigned: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Movement of each cluster's mean between blocks; without a counterpart its status says so, and it counts as drift."""
    means = assigned.groupBy("label", "cluster").pivot("block", ["before", "after"]).agg(*[F.avg(f).alias(f) for f in features])
    side = lambda b: F.array(*[F.col(f"{b}_{f}") if len(features) > 1 else F.col(b) for f in features])
    gone, new = F.col(f"after_{features[0]}" if len(features) > 1 else "after").isNull(), F.col(f"before_{features[0]}" if len(features) > 1 else "before").isNull()
    status = F.when(gone, "disappeared").when(new, "appeared").otherwise("matched")
    rows = means.select("label", "cluster", status.alias("status"), F.when(~gone & ~new, distance(side("before"), side("after"))).alias("distance"))
    return rows.withColumn("drift", (F.col("status") != "matched") | (F.col("distance") > threshold))


def mean_distance_shift(assigned: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Relative change of the mean distance of rows to their centre; without a counterpart it counts as drift."""
    rows = assigned.groupBy("label", "cluster").pivot("block", ["before", "after"]).agg(F.avg("distance"))
    shift = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before"))
    return rows.withColumn("shift", shift).withColumn("drift", F.coalesce(F.abs("shift") > threshold, F.col("before").isNull() | F.col("after").isNull()))


def strength(count: DataFrame, stats: DataFrame, centroid: DataFrame, mean_distance: DataFrame, t: Thresholds) -> DataFrame:
    """For each class the share of drifting items of the four criteria, weighted; drift if the strength exceeds t.decision.

    count: (label, drift) of clusters that appeared or disappeared, the others with a row for each item of a criterion.
    """
    total = sum(t.weights)
    parts = [d.groupBy("label").agg(F.avg(F.col("drift").cast("double")).alias("share")).withColumn("weight", F.lit(w / total)) for d, w in zip((count, stats, centroid, mean_distance), t.weights, strict=True)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.groupBy("label").agg(F.sum(F.col("share") * F.col("weight")).alias("strength")).withColumn("drift", F.col("strength") > t.decision)


def detect(rows: DataFrame, features: list[str], t: Thresholds | None = None, k_max: int = 10, seed: int = 0) -> DataFrame:
    """End to end over standardised rows (label, block, features): strength and decision of each class."""
    t = t or Thresholds()
    limit = t.scaled(t.match, len(features))
    centers = materialize(global_ids(fit_centers(rows, features, k_max, seed), limit), "centers")
    assigned = assign(rows, centers, features)
    count = centers.select("label", "cluster", (F.col("status") != "matched").alias("drift")).distinct()
    return strength(count, flag_stats(cluster_stats(assigned, features), t.stats_shift), centroid_shift(assigned, features, t.scaled(t.centroid_shift, len(features))), mean_distance_shift(assigned, t.distance_shift), t)


def report_clusters(centers: DataFrame) -> DataFrame:
    """Cluster numbers of each class before and after, sorted and joined by commas."""
    ids = F.array_join(F.array_sort(F.collect_set(F.col("cluster"))), ",")
    return centers.groupBy("label").pivot("block", ["before", "after"]).agg(ids)


def spanning_tree(matrix: DataFrame, core: int) -> list[tuple[float, int, int]]:
    """Edges (reach, i, j) of a least spanning tree of a matrix (i, j, value) by the mutual reach of its rows.

    The reach of a pair is the largest of its distance and both rows' distances to their core-th nearest row, themselves
    included. In each round every part takes its shortest edge to another part; the driver sees one edge a part.
    """
    nearest = F.row_number().over(Window.partitionBy("i").orderBy("value"))  # one row of the matrix
    sizes = matrix.groupBy("i").agg(F.count("*").alias("_n"))
    cores = matrix.withColumn("_k", nearest).join(sizes, "i").where(F.col("_k") == F.least(F.lit(core), F.col("_n"))).select("i", F.col("value").alias("c"))
    side = lambda k, c: cores.select(F.col("i").alias(k), F.col("c").alias(c))
    pairs = matrix.where("i < j").join(side("i", "ci"), "i").join(side("j", "cj"), "j").select("i", "j", F.greatest("value", "ci", "cj").alias("d")).persist()
    part = {r.i: r.i for r in sizes.select("i").collect()}

    def find(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    edges: list[tuple[float, int, int]] = []
    while len({find(i) for i in part}) > 1:
        now = matrix.sparkSession.createDataFrame([(int(i), int(find(i))) for i in part], "i int, p int")
        at = lambda k, p: F.broadcast(now.select(F.col("i").alias(k), F.col("p").alias(p)))  # noqa: E731  a row for each window
        apart = pairs.join(at("i", "pi"), "i").join(at("j", "pj"), "j").where("pi <> pj").select(F.explode(F.array("pi", "pj")).alias("p"), F.struct("d", "i", "j").alias("e"))
        found = [r.e for r in apart.groupBy("p").agg(F.min("e").alias("e")).collect()]
        if not found:
            break
        for e in sorted(found):
            a, b = find(e.i), find(e.j)
            if a != b:
                part[max(a, b)] = min(a, b)
                edges.append((e.d, e.i, e.j))
    pairs.unpersist()
    return sorted(edges)


def density_labels(points: list[int], edges: list[tuple[float, int, int]], min_cluster_size: int = 3) -> dict[int, int]:
    """Labels (-1 for outliers) of a density hierarchy over a spanning tree in rising order, clusters by excess of mass."""
    labels = dict.fromkeys(points, -1)
    n = len(points)
    if n < min_cluster_size or len(edges) < n - 1:
        return labels
    top, number = {p: k for k, p in enumerate(points)}, list(range(n))
    tree, size, least = [], [1] * n, list(points)
    for d, i, j in edges:
        sides = []
        for p in (top[i], top[j]):
            while number[p] != p:
                number[p] = p = number[number[p]]
            sides.append(p)
        tree.append((*sides, d))
        number.append(n + len(tree) - 1)
        number[sides[0]] = number[sides[1]] = n + len(tree) - 1
        size.append(size[sides[0]] + size[sides[1]])
        least.append(min(least[sides[0]], least[sides[1]]))

    born, stability, below, start = [0.0], [0.0], [[]], [n + len(tree) - 1]
    todo = [(start[0], 0)]
    while todo:  # from the top: a branch that splits in two large ones ends its cluster
        node, cluster = todo.pop()
        while node >= n:
            a, b, d = tree[node - n]
            density = 1 / max(d, 1e-12)
            large = [c for c in (a, b) if size[c] >= min_cluster_size]
            if len(large) != 1:
                stability[cluster] += (density - born[cluster]) * size[node]
                for c in large:
                    below[cluster].append(len(born))
                    todo.append((c, len(born)))
                    born.append(density)
                    stability.append(0.0)
                    below.append([])
                    start.append(c)
                break
            stability[cluster] += (density - born[cluster]) * (size[node] - size[large[0]])
            node = large[0]

    value, keeps = list(stability), [[c] for c in range(len(born))]
    for c in reversed(range(len(born))):  # a cluster's parts have larger numbers
        parts = sum(value[k] for k in below[c])
        if below[c] and (c == 0 or parts > stability[c]):
            value[c], keeps[c] = parts, [x for k in below[c] for x in keeps[k]]
    for label, c in enumerate(sorted((c for c in keeps[0] if c), key=lambda c: least[start[c]])):
        inner = [start[c]]
        while inner:
            node = inner.pop()
            if node >= n:
                inner += tree[node - n][:2]
            else:
                labels[points[node]] = label
    return labels


def hdbscan(distance_matrix: np.ndarray, min_cluster_size: int = 3) -> np.ndarray:
    """Labels (-1 for outliers) of the rows of a matrix in memory."""
    n = len(distance_matrix)
    core = np.sort(distance_matrix, 1)[:, min(min_cluster_size, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), distance_matrix)
    inside, best, near, edges = np.arange(n) == 0, reach[0].copy(), np.zeros(n, int), []
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[j]), int(near[j]), j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], near[closer] = reach[j][closer], j
    return np.array(list(density_labels(list(range(n)), sorted(edges), min_cluster_size).values()))


def cluster_windows(matrix: DataFrame, min_cluster_size: int = 3) -> DataFrame:
    """(win, label) of a matrix (i, j, value) of distances between windows, -1 for outliers.

    Distances stay distributed; the driver holds a spanning tree, one edge for each window of a thousand rows or more.
    """
    matrix = materialize(matrix, "window-matrix")  # every round of the tree reads it
    points = sorted(r.i for r in matrix.select("i").distinct().collect())
    labels = density_labels(points, spanning_tree(matrix, min_cluster_size), min_cluster_size)
    return matrix.sparkSession.createDataFrame([(int(w), int(k)) for w, k in labels.items()], "win int, label int")
