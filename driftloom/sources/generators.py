"""Synthetic streams with drift as expressions over row numbers; the same seed gives the same rows.

Every generator returns (seq, features..., target). Random numbers come from hashes of (seed, column, seq), so a row does not
depend on how the stream is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, column: str, low: float = 0.0, high: float = 1.0) -> Column:
    """U(low, high) for each row, from a hash of the seed, a column name and seq."""
    bits = F.xxhash64(F.lit(seed), F.lit(column), F.col("seq"))
    return F.lit(low) + (F.shiftrightunsigned(bits, 11).cast("double") / 2.0**53) * (high - low)


def normal(seed: int, column: str, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """N(mean, deviation) by the Box-Muller transform of two uniforms."""
    a, b = uniform(seed, f"{column}/a"), uniform(seed, f"{column}/b")
    return mean + deviation * F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def drift_probability(position: int, width: int, hard_below: int = 2) -> Column:
    """Share of the new concept around a position: a sigmoid over `width` rows, a hard switch where it has fewer than hard_below."""
    if width < hard_below:
        return (F.col("seq") >= position).cast("double")
    x = F.least(F.greatest(-4.0 * (F.col("seq") - position) / width, F.lit(-500.0)), F.lit(500.0))
    return 1 / (1 + F.exp(x))


def is_new(seed: int, position: int, width: int, hard_below: int = 2) -> Column:
    """One mask for features and target of a row."""
    return uniform(seed, "mix") < drift_probability(position, width, hard_below)


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "seq")


#: Thresholds of the four variants, and widths below which the drift is a hard switch.
SEA_LIMITS = (8.0, 9.0, 7.0, 9.5)
SEA_HARD_BELOW, HYPERPLANE_HARD_BELOW = 5, 50


def sea_variants(spark: SparkSession, n: int, variants: Sequence[int] = (0, 1, 2, 3), seed: int = 42) -> DataFrame:
    """A stream of n rows in equal parts, one for each variant in turn; rows that don't divide evenly are left out."""
    part = n // len(variants)
    limit = F.element_at(F.array(*[F.lit(SEA_LIMITS[v]) for v in variants]), (F.col("seq") / part).cast("int") + 1)
    df = _rows(spark, part * len(variants)).withColumns({f"x{i}": uniform(seed, f"x{i}", 0, 10) for i in (1, 2, 3)})
    return df.withColumn("target", (F.col("x1") + F.col("x2") <= limit).cast("int"))


def sea(spark: SparkSession, n_before: int, n_after: int, width: int = 1, seed: int = 42, variants: tuple[int, int] = (0, 3)) -> DataFrame:
    """Three features in [0, 10]; the target says whether the first two exceed a threshold that the drift changes."""
    limits = SEA_LIMITS
    limit = F.when(is_new(seed, n_before, width, SEA_HARD_BELOW), limits[variants[1]]).otherwise(limits[variants[0]])
    df = _rows(spark, n_before + n_after).withColumns({f"x{i}": uniform(seed, f"x{i}", 0, 10) for i in (1, 2, 3)})
    return df.withColumn("target", (F.col("x1") + F.col("x2") <= limit).cast("int"))


def hyperplane(spark: SparkSession, n_before: int, n_after: int, n_features: int = 5, n_drift_features: int = 2, width: int = 1, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """Uniform features and a weighted sum above half its largest value; the drift reverses the first weights."""
    if n_features < 2 or not 2 <= n_drift_features <= n_features:
        raise ValueError("need 2 <= n_drift_features <= n_features")
    names = [f"x{i}" for i in range(1, n_features + 1)]
    df = _rows(spark, n_before + n_after).withColumns({c: uniform(seed, c) for c in names})
    weights = [0.2 + 0.8 * ((i * 7919 + seed) % 97) / 97 for i in range(n_features)]
    total = lambda ws: reduce(lambda a, b: a + b, (F.col(c) * w for c, w in zip(names, ws, strict=True)))
    new = [1.2 - w if i < n_drift_features else w for i, w in enumerate(weights)]
    label = lambda ws: (total(ws) >= sum(ws) / 2).cast("int")
    target = F.when(is_new(seed, n_before, width, HYPERPLANE_HARD_BELOW), label(new)).otherwise(label(weights))
    return df.withColumn("target", F.when(uniform(seed, "noise") < noise, 1 - target).otherwise(target))


def rbf(spark: SparkSession, n_before: int, n_after: int, width: int = 1, seed: int = 42, noise: float = 0.0, gamma: float = 4.0) -> DataFrame:
    """Four features; the target is the class whose kernel responds more; the drift swaps the centres' classes."""
    centers = (((0.2, 0.2, 0.8, 0.5), 0), ((0.8, 0.7, 0.2, 0.4), 1), ((0.5, 0.9, 0.6, 0.1), 0), ((0.3, 0.4, 0.3, 0.9), 1))
    names = [f"x{i}" for i in range(1, 5)]
    df = _rows(spark, n_before + n_after).withColumns({c: uniform(seed, c) for c in names})
    kernel = lambda c: F.exp(-gamma * reduce(lambda a, b: a + b, (F.pow(F.col(x) - v, 2) for x, v in zip(names, c, strict=True))))
    response = [reduce(lambda a, b: a + b, (kernel(c) for c, cls in centers if cls == k)) for k in (0, 1)]
    label = (response[1] > response[0]).cast("int")
    target = F.when(is_new(seed, n_before, width), 1 - label).otherwise(label)
    return df.withColumn("target", F.when(uniform(seed, "noise") < noise, 1 - target).otherwise(target))


def moving_rbf(spark: SparkSession, n_before: int, n_after: int, n_centers: int = 8, n_features: int = 4, speed: float = 0.0005, seed: int = 42) -> DataFrame:
    """Rows around random centres, each of a class; after n_before rows the centres move at a constant speed."""
    df = _rows(spark, n_before + n_after).withColumn("c", F.floor(uniform(seed, "center") * n_centers))
    moved = F.greatest(F.col("seq") - n_before, F.lit(0)) * speed
    at = lambda f, what: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(f"{what}{f}"), F.col("c")), 11).cast("double") / 2.0**53
    df = df.withColumns({f"x{i}": at(i, "place") + (at(i, "way") - 0.5) * moved + normal(seed, f"x{i}", 0, 0.08) for i in range(1, n_features + 1)})
    return df.withColumn("target", (F.col("c") % 2).cast("int")).drop("c")


def weight_inversion(spark: SparkSession, n_before: int, n_after: int, n_features: int = 11, n_drift_features: int = 5, width: int = 1, seed: int = 42) -> DataFrame:
    """U(0, 1) features and the sign of a noisy sum against its median, so that classes are balanced; the drift turns the
    weights of the first features from +1 to -1."""
    if n_drift_features > n_features:
        raise ValueError("n_drift_features exceeds n_features")
    names = [f"x{i}" for i in range(1, n_features + 1)]
    df = _rows(spark, n_before + n_after).withColumns({c: uniform(seed, c) for c in names})
    score = lambda ws: reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(names, ws, strict=True))) + normal(seed, "noise", 0, 0.1)
    old, new = score([1] * n_features), score([-1 if i < n_drift_features else 1 for i in range(n_features)])
    mid = lambda ws: sum(ws) / 2  # noqa: E731  the median of a sum of symmetric terms
    label = F.when(is_new(seed, n_before, width), new > mid([-1 if i < n_drift_features else 1 for i in range(n_features)])).otherwise(old > mid([1] * n_features))
    return df.withColumn("target", label.cast("int"))


def drift_factor(position: int, duration: int) -> Column:
    """How far a drift of `duration` rows from `position` has come at a row, 0 outside it: a sigmoid of what remains."""
    half = duration / 2
    remaining = position + duration - F.col("seq")
    inside = F.col("seq").between(position, position + duration - 1)
    return F.when(inside, 1 / (1 + F.exp(2 * (remaining - half) / half))).otherwise(0.0)


def _concept(positions: Sequence[int], duration: int, seed: int) -> Column:
    """How many drifts a row has seen; within a drift the new concept comes with the drift's probability."""
    seen = F.lit(0)
    for k, p in enumerate(positions):
        done = F.col("seq") >= p + duration
        within = F.col("seq").between(p, p + duration - 1) & (uniform(seed, f"drift{k}") < drift_factor(p, max(duration, 1)))
        seen = seen + (done | within).cast("int")
    return seen


def positions_of(text: str | Sequence[int]) -> list[int]:
    """Drift positions from a list or a comma-separated text; none for an empty one."""
    return [int(p) for p in text.split(",") if p.strip()] if isinstance(text, str) else [int(p) for p in text]


def sine(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """Six curves of one uniform draw; the target compares two of them, and each drift picks another pair."""
    u = uniform(seed, "u", 0, 2 * math.pi)
    df = _rows(spark, n).withColumn("u", u)
    curves = [F.sin("u"), F.cos("u"), F.sin(2 * F.col("u")), F.cos(2 * F.col("u")), F.sin("u") * F.cos("u"), F.sin(F.col("u") + 1)]
    df = df.withColumns({f"x{i}": c for i, c in enumerate(curves)}).withColumn("k", _concept(positions, duration, seed))
    pairs = [(a, b) for a in range(6) for b in range(6) if a != b]
    label = F.lit(None).cast("int")
    for k in range(len(positions) + 1):
        a, b = pairs[(seed + 7 * k) % len(pairs)]
        label = F.when(F.col("k") == k, (F.col(f"x{a}") > F.col(f"x{b}")).cast("int")).otherwise(label)
    return df.withColumn("target", label).drop("u", "k")


def plane(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 100, seed: int = 42) -> DataFrame:
    """U(-1, 1)^3 and the side of a plane through the origin that each drift turns by 90 degrees, gradually."""
    df = _rows(spark, n).withColumns({f"x{i}": uniform(seed, f"x{i}", -1, 1) for i in range(3)})
    angle = F.lit((seed % 360) * math.pi / 180)
    for k, p in enumerate(positions):
        turn = (1 if (seed + k) % 2 else -1) * math.pi / 2
        angle = angle + turn * F.least(F.greatest((F.col("seq") - p) / max(duration, 1), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("target", (F.cos(angle) * F.col("x0") + F.sin(angle) * F.col("x1") + 0.5 * F.col("x2") > 0).cast("int"))


def random_tree(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42, depth: int = 3) -> DataFrame:
    """Clipped N(0.5, 0.2) features labelled by a random tree of depth 3; each drift flips the labels."""
    import random

    rng = random.Random(seed)
    names = [f"x{i}" for i in range(6)]

    def tree(level: int) -> Column:
        if level == depth:
            return F.lit(rng.randint(0, 1))
        test = F.col(rng.choice(names)) > rng.uniform(0.35, 0.65)
        return F.when(test, tree(level + 1)).otherwise(tree(level + 1))

    df = _rows(spark, n).withColumns({c: F.least(F.greatest(normal(seed, c, 0.5, 0.2), F.lit(0.0)), F.lit(1.0)) for c in names})
    return df.withColumn("target", ((tree(0) + _concept(positions, duration, seed)) % 2).cast("int"))


def stagger(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """Nine indicators of size, colour and shape; three rules take turns with the drifts."""
    draw = {k: F.floor(uniform(seed, k) * 3).cast("int") for k in ("size", "color", "shape")}
    df = _rows(spark, n).withColumns(draw).withColumn("k", _concept(positions, duration, seed) % 3)
    rules = [(F.col("size") == 0) & (F.col("color") == 0), (F.col("color") == 1) | (F.col("shape") == 1), (F.col("size") == 1) | (F.col("size") == 2)]
    label = reduce(lambda case, x: F.when(F.col("k") == x[0], x[1]).otherwise(case), enumerate(rules), F.lit(False))
    df = df.withColumns({f"{k}_{v}": (F.col(k) == v).cast("int") for k in draw for v in range(3)})
    return df.withColumn("target", label.cast("int")).drop("k", *draw)


def mixed(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """Two flags and two numbers; the target holds if two of three conditions do, and each drift reverses it."""
    df = _rows(spark, n).withColumns({"x0": (uniform(seed, "x0") < 0.5).cast("int"), "x1": (uniform(seed, "x1") < 0.5).cast("int"), "x2": uniform(seed, "x2"), "x3": uniform(seed, "x3")})
    curve = (F.col("x3") < 0.5 + 0.3 * F.sin(3 * math.pi * F.col("x2"))).cast("int")
    votes = F.col("x0") + F.col("x1") + curve
    return df.withColumn("target", (((votes >= 2).cast("int") + _concept(positions, duration, seed)) % 2).cast("int"))


def multi_sea(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """SEA scaled to [0, 1]; the drifts step through the four thresholds."""
    df = _rows(spark, n).withColumns({f"x{i}": uniform(seed, f"x{i}") for i in range(3)}).withColumn("k", _concept(positions, duration, seed) % 4)
    limit = F.element_at(F.array(*map(F.lit, (0.8, 0.9, 0.7, 0.95))), F.col("k") + 1)
    return df.withColumn("target", (F.col("x0") + F.col("x1") <= limit).cast("int")).drop("k")


def multi_rbf(spark: SparkSession, n: int, positions: Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """Five features around fifteen centres of three classes; each drift moves every class on by one."""
    df = _rows(spark, n).withColumn("c", F.floor(uniform(seed, "c") * 15))
    at = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(f"place{i}"), F.col("c")), 11).cast("double") / 2.0**53
    df = df.withColumns({f"x{i}": at(i) + normal(seed, f"x{i}", 0, 0.05) for i in range(5)})
    return df.withColumn("target", ((F.col("c") + _concept(positions, duration, seed)) % 3).cast("int")).drop("c")


def blobs(spark: SparkSession, n: int = 5000, features: int = 2, classes: int = 2, seed: int = 42) -> DataFrame:
    """Gaussian blobs in the unit cube."""
    df = _rows(spark, n).withColumn("target", F.floor(uniform(seed, "class") * classes).cast("int"))
    at = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(f"at{i}"), F.col("target")), 11).cast("double") / 2.0**53
    return df.withColumns({f"x{i}": F.least(F.greatest(at(i) + normal(seed, f"x{i}", 0, 0.06), F.lit(0.0)), F.lit(1.0)) for i in range(features)})


def axis_swap(spark: SparkSession, n_before: int, n_after: int, ranges: Sequence[tuple[float, float]] = ((0, 1), (0, 1), (0, 1), (0, 1)), seed: int = 42) -> DataFrame:
    """A boundary on the first two features that moves to the last two after the drift, rescaled to raw ranges."""
    names = [f"x{i}" for i in range(len(ranges))]
    df = _rows(spark, n_before + n_after).withColumns({c: uniform(seed, c) for c in names})
    old, new = F.col(names[0]) + F.col(names[1]) > 1, F.col(names[-1]) + F.col(names[-2]) > 1
    df = df.withColumn("target", F.when(F.col("seq") >= n_before, new).otherwise(old).cast("int"))
    return df.withColumns({c: F.col(c) * (hi - lo) + lo for c, (lo, hi) in zip(names, ranges, strict=True)})


MULTI: dict[str, Callable[..., DataFrame]] = {"sine": sine, "plane": plane, "random_tree": random_tree, "stagger": stagger, "mixed": mixed, "sea": multi_sea, "rbf": multi_rbf}
TWO_BLOCKS: dict[str, Callable[..., DataFrame]] = {"sea": sea, "hyperplane": hyperplane, "rbf": rbf, "moving_rbf": moving_rbf, "weight_inversion": weight_inversion, "axis_swap": axis_swap}


def multi_window(spark: SparkSession, name: str, num_windows: int = 100, window_length: int = 1000, drift_positions: str | Sequence[int] = (), duration: int = 1, seed: int = 42) -> DataFrame:
    """num_windows x window_length rows of a named stream with the given drifts."""
    if name not in MULTI:
        raise ValueError(f"unknown stream {name}; one of {sorted(MULTI)}")
    return MULTI[name](spark, num_windows * window_length, positions_of(drift_positions), duration, seed=seed)


#: Fixed settings by name: stream, drift positions and length of each drift in 100 000 rows.
NAMED = {f"{name}{n}": (name, [100_000 * (i + 1) // (n + 1) for i in range(n)], 1000) for name in ("sine", "plane", "random_tree", "stagger") for n in (1, 2, 3)}


def named(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    stream, positions, duration = NAMED[name]
    return MULTI[stream](spark, 100_000, positions, duration, seed=seed)
