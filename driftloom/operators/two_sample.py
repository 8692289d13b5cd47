"""Two-sample tests and divergences between blocks, for each class and feature.

Every function takes long rows (label, feature, block, value) and gives one row for each (label, feature). Values are
collapsed to counts of distinct values first, so running sums go over distinct values of one class and feature only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by_value, mid_ranks, null_safe_join, numbered, quantiles

KEYS = ["label", "feature"]
BINS, SMALL, REACH = 30, 1e-10, 9.0


def scaled_by_before(long: DataFrame) -> DataFrame:
    """Min-max scaling of each feature, fitted on the block before; constant features become 0, others may leave [0, 1]."""
    before = F.when(F.col("block") == "before", F.col("value"))
    fitted = long.groupBy("feature").agg(F.min(before).alias("lo"), F.max(before).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return long.join(F.broadcast(fitted), "feature").withColumn("value", scaled).drop("lo", "hi")  # a row for each feature


def standardised_by_before(long: DataFrame) -> DataFrame:
    """Standardisation of each feature with mean and population deviation of the block before; deviation 0 counts as 1."""
    before = F.when(F.col("block") == "before", F.col("value"))
    fitted = long.groupBy("feature").agg(F.avg(before).alias("mu"), F.stddev_pop(before).alias("sd"))
    scaled = (F.col("value") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return long.join(F.broadcast(fitted), "feature").withColumn("value", scaled).drop("mu", "sd")


def cumulative(long: DataFrame) -> DataFrame:
    """Distinct values of each class and feature with counts (c0, c1), running counts (k0, k1), totals (n0, n1) and the
    next value (_next)."""
    of = lambda b: F.sum((F.col("block") == b).cast("long"))
    counts = long.groupBy(*KEYS, "value").agg(of("before").alias("c0"), of("after").alias("c1"))
    rows = by_value(counts, KEYS, {"c0": "0", "c1": "1"})
    return rows.withColumnsRenamed({"run_0": "k0", "run_1": "k1", "all_0": "n0", "all_1": "n1"})


def _gap() -> Column:
    return F.abs(F.try_divide("k0", "n0") - F.try_divide("k1", "n1"))


def ks_p_value(d: Column, n0: Column, n1: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p of the two-sample Kolmogorov-Smirnov statistic (the Kolmogorov series)."""
    z2 = F.try_divide(d * d * n0 * n1, n0 + n1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z2))
    return F.when(z2 < 0.03, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def _by_cell(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.max("n0").alias("n_before"), F.max("n1").alias("n_after"), value.alias("stat"))


def _missing() -> Column:
    return (F.col("n_before") == 0) | (F.col("n_after") == 0)


def _decide(cells: DataFrame, drift: Column) -> DataFrame:
    """A class missing in a block has no statistic and counts as drift."""
    return cells.withColumn("stat", F.when(~_missing(), F.col("stat"))).withColumn("drift", F.when(_missing(), True).otherwise(drift))


def kolmogorov_smirnov(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    cells = _by_cell(cumulative(long), F.max(_gap())).withColumn("p_value", ks_p_value(F.col("stat"), F.col("n_before"), F.col("n_after")))
    return _decide(cells.withColumn("p_value", F.when(~_missing(), F.col("p_value"))), F.col("p_value") < alpha)


def wasserstein(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    """First Wasserstein distance; scale the values first to compare features."""
    rows = cumulative(long).withColumn("part", _gap() * (F.col("_next") - F.col("value")))
    return _decide(_by_cell(rows, F.coalesce(F.sum("part"), F.lit(0.0))), F.col("stat") > threshold)


def histograms(long: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts (c0, c1) in equal bins over the range of the block before of each class and feature; values outside drop.

    Every bin is there, the last one closed on the right. A class missing before has no bins.
    """
    before = F.when(F.col("block") == "before", F.col("value"))
    ranges = long.groupBy(*KEYS).agg(F.min(before).alias("lo"), F.max(before).alias("hi")).where("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    inside = long.join(ranges, KEYS).where(F.col("value").between(F.col("lo"), F.col("hi")))
    binned = inside.withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int"))
    of = lambda b: F.sum((F.col("block") == b).cast("long"))
    counts = binned.groupBy(*KEYS, "bin").agg(of("before").alias("c0"), of("after").alias("c1"))
    every = ranges.select(*KEYS, width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*KEYS, "bin"], "left").fillna(0, ["c0", "c1"])


def _densities(long: DataFrame, bins: int) -> DataFrame:
    """Densities p (before) and q (after) of the bins, each raised a little and brought to sum 1."""
    every = Window.partitionBy(*KEYS)
    h = histograms(long, bins)
    raw = lambda i: F.coalesce(F.try_divide(F.col(f"c{i}"), F.sum(f"c{i}").over(every) * F.col("width") / bins), F.lit(0.0)) + SMALL
    h = h.withColumns({"d0": raw(0), "d1": raw(1), "n0": F.sum("c0").over(every), "n1": F.sum("c1").over(every)})
    return h.withColumns({"p": F.col("d0") / F.sum("d0").over(every), "q": F.col("d1") / F.sum("d1").over(every)})


def kullback_leibler(long: DataFrame, threshold: float = 0.1, bins: int = BINS) -> DataFrame:
    return _decide(_by_cell(_densities(long, bins), F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))), F.col("stat") > threshold)


def jensen_shannon(long: DataFrame, threshold: float = 0.05, bins: int = BINS) -> DataFrame:
    """The divergence in nats (the squared distance)."""
    p, q = F.col("p"), F.col("q")
    half = lambda x: 0.5 * x * F.log(2 * x / (p + q))
    return _decide(_by_cell(_densities(long, bins), F.sum(half(p) + half(q))), F.col("stat") > threshold)


def spearman(long: DataFrame, order: list[str], threshold: float = 0.9) -> DataFrame:
    """Rank correlation of rows paired by position within class, feature and block; the longer block is cut.

    `order` names the columns of the total order. |rho| below the threshold is drift.
    """
    placed = numbered(long.select(*KEYS, "block", "value", *order), [*KEYS, "block"], order, "at")
    side = lambda b: F.max(F.when(F.col("block") == b, F.struct("value"))).alias(b)
    pairs = placed.groupBy(*KEYS, "at").agg(side("before"), side("after")).where("before is not null and after is not null")
    ranked = mid_ranks(pairs.select(*KEYS, F.col("before.value").alias("x"), F.col("after.value").alias("y")), KEYS, {"x": "rx", "y": "ry"})
    cells = ranked.groupBy(*KEYS).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("stat"))
    return cells.withColumn("drift", F.coalesce(F.abs("stat") < threshold, F.lit(True)))


#: Critical values of the normalised statistic for two samples and their significance levels.
AD_CRITICAL = (0.325, 1.226, 1.961, 2.718, 3.752, 4.592, 6.546)
AD_LEVELS = (0.25, 0.10, 0.05, 0.025, 0.01, 0.005, 0.001)


def ad_p_value(stat: Column) -> Column:
    """p by a quadratic fit of log p to the critical values (least squares), within [0.001, 0.25]."""
    x, y = AD_CRITICAL, [math.log(p) for p in AD_LEVELS]
    s = [sum(v**k for v in x) for k in range(5)]
    t = [sum(w * v**k for v, w in zip(x, y, strict=True)) for k in range(3)]
    a = [[s[i + j] for j in range(3)] + [t[i]] for i in range(3)]
    for i in range(3):  # elimination of a 3 x 3 system
        a[i] = [v / a[i][i] for v in a[i]]
        for j in range(3):
            if j != i:
                a[j] = [v - a[j][i] * w for v, w in zip(a[j], a[i], strict=True)]
    fit = F.exp(a[0][3] + a[1][3] * stat + a[2][3] * stat * stat)
    inside = F.when(stat <= x[0], AD_LEVELS[0]).when(stat >= x[-1], AD_LEVELS[-1]).otherwise(fit)
    return F.least(F.greatest(inside, F.lit(AD_LEVELS[-1])), F.lit(AD_LEVELS[0]))


def harmonic(m: Column, listed: int = 64) -> tuple[Column, Column]:
    """Sums of 1 / i and of 1 / i**2 up to m: term by term up to `listed`, beyond by their expansions, which are exact in double
    precision there."""
    terms = lambda power: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(listed)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.pow(i.cast("double"), F.lit(power)))
    r = 1.0 / m
    r2 = r * r
    first = F.log(m) + 0.5772156649015329 + r / 2 - r2 * (1 / 12 - r2 * (1 / 120 - r2 / 252))
    second = math.pi**2 / 6 - r * (1 - r / 2 + r2 * (1 / 6 - r2 * (1 / 30 - r2 / 42)))
    return F.when(m <= listed, terms(1)).otherwise(first), F.when(m <= listed, terms(2)).otherwise(second)


def anderson_darling(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-sample Anderson-Darling with mid-ranks: raw statistic a2, normalised stat, p_value and drift."""
    rows = cumulative(long)
    n0, n1 = F.col("n0"), F.col("n1")
    l, total = F.col("c0") + F.col("c1"), n0 + n1  # noqa: E741
    b = F.col("k0") + F.col("k1") - l / 2
    m = lambda i: F.col(f"k{i}") - F.col(f"c{i}") / 2
    below = b * (total - b) - total * l / 4
    part = l / total * (F.try_divide(F.pow(total * m(0) - b * n0, 2), n0) + F.try_divide(F.pow(total * m(1) - b * n1, 2), n1)) / F.when(below != 0, below)
    cells = rows.groupBy(*KEYS).agg(F.max("n0").alias("n_before"), F.max("n1").alias("n_after"), (F.sum(part) * F.max((total - 1) / total)).alias("a2"))
    n = (F.col("n_before") + F.col("n_after")).cast("double")
    big_h = F.try_divide(F.lit(1), F.col("n_before")) + F.try_divide(F.lit(1), F.col("n_after"))
    small_h, squares = harmonic(n - 1)
    # the sum over i < j < n of 1 / ((n - i) j) has this closed form, by the convolution of harmonic numbers
    tail = squares - 2 * small_h / n
    k = 2
    a = (4 * F.col("tail") - 6) * (k - 1) + (10 - 6 * F.col("tail")) * F.col("inverse_sizes")
    bb = (2 * F.col("tail") - 4) * k**2 + 8 * F.col("harmonic") * k + (2 * F.col("tail") - 14 * F.col("harmonic") - 4) * F.col("inverse_sizes") - 8 * F.col("harmonic") + 4 * F.col("tail") - 6
    c = (6 * F.col("harmonic") + 2 * F.col("tail") - 2) * k**2 + (4 * F.col("harmonic") - 4 * F.col("tail") + 6) * k + (2 * F.col("harmonic") - 6) * F.col("inverse_sizes") + 4 * F.col("harmonic")
    d = (2 * F.col("harmonic") + 6) * k**2 - 4 * F.col("harmonic") * k
    sigma2 = (a * n**3 + bb * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3))
    cells = cells.where("n_before + n_after > 3").withColumns({"inverse_sizes": big_h, "harmonic": small_h, "tail": tail})
    cells = cells.withColumn("stat", (F.col("a2") - (k - 1)) / F.sqrt(sigma2)).withColumn("p_value", ad_p_value(F.col("stat"))).drop("inverse_sizes", "harmonic", "tail")
    return _decide(cells, F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def run_all(long: DataFrame, order: list[str], tests: str | list[str] = "all") -> DataFrame:
    """(test, label, feature, stat, drift) of one, some or all tests."""
    scaled = scaled_by_before(long)
    by_name = {
        "ks": lambda: kolmogorov_smirnov(long), "kl": lambda: kullback_leibler(scaled), "wasserstein": lambda: wasserstein(scaled),
        "js": lambda: jensen_shannon(scaled), "spearman": lambda: spearman(long, order), "anderson_darling": lambda: anderson_darling(long),
    }
    names = list(by_name) if tests == "all" else [tests] if isinstance(tests, str) else list(tests)
    if unknown := set(names) - set(by_name):
        raise ValueError(f"unknown tests: {sorted(unknown)}")
    parts = [by_name[t]().select(F.lit(t).alias("test"), *KEYS, "stat", "drift") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def vote(cells: DataFrame, drift_threshold: float = 0.2, decision: float = 0.4) -> DataFrame:
    """A test drifts if the share of its cells that do exceeds drift_threshold; overall the share of tests decides."""
    per_test = cells.groupBy("test").agg((F.avg(F.col("drift").cast("double")) > drift_threshold).alias("test_drift"))
    return per_test.withColumn("drift", F.avg(F.col("test_drift").cast("double")).over(Window.partitionBy()) > decision)


def ecdf(long: DataFrame) -> DataFrame:
    """Cumulative shares of both blocks at every distinct value."""
    return cumulative(long).select(*KEYS, "value", F.try_divide("k0", "n0").alias("before"), F.try_divide("k1", "n1").alias("after"))


def quartiles(long: DataFrame) -> DataFrame:
    """Five numbers of a box plot by class, feature and block."""
    keys = [*KEYS, "block"]
    ends = long.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    cells = null_safe_join(ends, quantiles(long, keys, {"q1": 0.25, "q2": 0.5, "q3": 0.75}), keys, "left")
    return cells.select(*keys, "low", "q1", "q2", "q3", "high")


def kernel_density(long: DataFrame, points: int = 1000) -> DataFrame:
    """Gaussian kernel density of each class, feature and block on `points` points over the joint range, bandwidth by
    Scott's rule. A distinct value adds to the points within REACH bandwidths only; beyond, kernels are below 1e-17."""
    spread = long.groupBy(*KEYS, "block").agg(F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    joint = long.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cells = spread.join(joint, KEYS).withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).where("h > 0")
    cells = cells.withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
    place = lambda side: (F.col("value") + side * REACH * F.col("h") - F.col("lo")) / F.col("step")
    first, last = F.greatest(F.ceil(place(-1)), F.lit(0)), F.least(F.floor(place(1)), F.lit(points - 1))
    values = long.groupBy(*KEYS, "block", "value").count().join(cells, [*KEYS, "block"])
    near = values.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    z = (F.col("lo") + F.col("i") * F.col("step") - F.col("value")) / F.col("h")
    sums = near.groupBy(*KEYS, "block", "i").agg(F.sum(F.col("count") * F.exp(-0.5 * z * z)).alias("kernels"))
    grid = cells.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    density = F.coalesce("kernels", F.lit(0.0)) / (F.col("n") * F.col("h")) / math.sqrt(2 * math.pi)
    return grid.join(sums, [*KEYS, "block", "i"], "left").select(*KEYS, "block", (F.col("lo") + F.col("i") * F.col("step")).alias("x"), density.alias("density"))
