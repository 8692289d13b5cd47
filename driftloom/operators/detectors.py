"""Detectors over prequential error streams, and where a drift starts and ends."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .ordered import running, segmented


def majority_errors(rows: DataFrame) -> DataFrame:
    """Errors (stream_id, seq, err) of predicting the most frequent label so far, ties to the largest label; the first row
    of a stream counts as an error. Rows are (stream_id, seq, label); there are few distinct labels."""
    rows = materialize(rows.select("stream_id", "seq", "label"), "labels")
    labels = rows.select("label").distinct().agg(F.array_sort(F.collect_set("label")).alias("ls"))
    spread = rows.crossJoin(F.broadcast(labels)).select("stream_id", "seq", "label", F.explode("ls").alias("cand"))
    spread = segmented(spread.withColumn("_hit", (F.col("label") == F.col("cand")).cast("long")), "seq")
    counted = running(spread, ["stream_id", "cand"], ["seq"], {"_hit": "hit"}).withColumn("n", F.col("run_hit") - F.col("_hit"))
    best = counted.groupBy("stream_id", "seq").agg(F.max(F.struct("n", "cand")).alias("b"), F.first("label").alias("label"))
    return best.select("stream_id", "seq", F.when(F.col("b.n") == 0, 1).otherwise((F.col("b.cand") != F.col("label")).cast("int")).alias("err"))


@dataclass
class DDM:
    """Error rate and its deviation against their minimum."""

    warm_start: int = 30
    warning: float = 2.0
    drift: float = 3.0
    n: int = 0
    p: float = 0.0
    best: tuple[float, float] = (math.inf, math.inf)

    def update(self, err: int) -> tuple[bool, bool]:
        self.n += 1
        self.p += (err - self.p) / self.n
        if self.n < self.warm_start:
            return False, False
        s = math.sqrt(self.p * (1 - self.p) / self.n)
        if self.p + s <= sum(self.best):
            self.best = self.p, s
        low, dev = self.best
        return self.p + s > low + self.warning * dev, self.p + s > low + self.drift * dev


@dataclass
class EDDM:
    """Mean distance between errors plus twice its deviation against its maximum."""

    warm_start: int = 30
    warning: float = 0.95
    drift: float = 0.90
    n: int = 0
    last: int = 0
    count: int = 0
    mean: float = 0.0
    m2: float = 0.0
    top: float = 0.0

    def update(self, err: int) -> tuple[bool, bool]:
        self.n += 1
        if not err:
            return False, False
        gap, self.last = self.n - self.last, self.n
        self.count += 1
        delta = gap - self.mean
        self.mean += delta / self.count
        self.m2 += delta * (gap - self.mean)
        level = self.mean + 2 * math.sqrt(self.m2 / self.count)
        if self.count < self.warm_start:
            self.top = max(self.top, level)
            return False, False
        if level >= self.top:
            self.top = level
            return False, False
        ratio = level / self.top
        return ratio < self.warning, ratio < self.drift


@dataclass
class FHDDM:
    """Accuracy over a sliding window against its maximum, by Hoeffding's bound; it has no warning level."""

    size: int = 100
    confidence: float = 1e-6
    window: deque = field(default_factory=deque)
    right: int = 0
    top: float = 0.0

    def update(self, err: int) -> tuple[bool, bool]:
        self.window.append(1 - err)
        self.right += 1 - err
        if len(self.window) > self.size:
            self.right -= self.window.popleft()
        if len(self.window) < self.size:
            return False, False
        p = self.right / self.size
        self.top = max(self.top, p)
        return False, self.top - p > math.sqrt(math.log(1 / self.confidence) / (2 * self.size))


@dataclass
class HDDMA:
    """Hoeffding's bound on the difference of averages before and after the best cut so far."""

    drift: float = 0.001
    warning: float = 0.005
    n: int = 0
    total: float = 0.0
    cut_n: int = 0
    cut_total: float = 0.0

    def update(self, err: int) -> tuple[bool, bool]:
        self.n += 1
        self.total += err
        bound = lambda n, a: math.sqrt(math.log(1 / a) / (2 * n))
        if self.cut_n == 0 or self.cut_total / self.cut_n + bound(self.cut_n, self.drift) >= self.total / self.n + bound(self.n, self.drift):
            self.cut_n, self.cut_total = self.n, self.total
        if self.cut_n == self.n:
            return False, False
        rise = self.total / self.n - self.cut_total / self.cut_n
        share = (self.n - self.cut_n) / self.n
        over = lambda a: rise >= math.sqrt(share / self.cut_n * math.log(1 / a) / 2)
        return over(self.warning), over(self.drift)


@dataclass
class HDDMW:
    """McDiarmid's bound on the difference of exponentially weighted averages before and after the best cut."""

    drift: float = 0.001
    warning: float = 0.005
    decay: float = 0.05
    total: list | None = None
    cut: list | None = None
    after: list | None = None

    def _add(self, state: list | None, err: int) -> list:
        if state is None:
            return [float(err), 1.0]
        a, keep = self.decay, 1 - self.decay
        return [a * err + keep * state[0], a * a + keep * keep * state[1]]

    def update(self, err: int) -> tuple[bool, bool]:
        self.total = self._add(self.total, err)
        bound = lambda s, a: math.sqrt(s[1] * math.log(1 / a) / 2)
        if self.cut is None or self.total[0] + bound(self.total, self.drift) <= self.cut[0] + bound(self.cut, self.drift):
            self.cut, self.after = list(self.total), None
            return False, False
        self.after = self._add(self.after, err)
        over = lambda a: self.after[0] - self.cut[0] > math.sqrt((self.cut[1] + self.after[1]) * math.log(1 / a) / 2)
        return over(self.warning), over(self.drift)


@dataclass
class ADWIN:
    """A window of exponential buckets that drops its older part when two parts differ too much."""

    delta: float = 0.002
    clock: int = 32
    width_limit: int = 5
    rows: list = field(default_factory=list)  # rows[k]: up to width_limit buckets of 2**k values as sums, newest first
    n: int = 0

    def update(self, err: int) -> tuple[bool, bool]:
        self.n += 1
        carry, k = float(err), 0
        while carry is not None:
            if k == len(self.rows):
                self.rows.append([])
            self.rows[k].insert(0, carry)
            carry = None
            if len(self.rows[k]) > self.width_limit:
                carry = self.rows[k].pop() + self.rows[k].pop()
            k += 1
        return False, self.n % self.clock == 0 and self._shrink()

    def _shrink(self) -> bool:
        buckets = [(2**k, s) for k, row in enumerate(self.rows) for s in row]  # newest first
        size, total = sum(b[0] for b in buckets), sum(b[1] for b in buckets)
        if size < 10:
            return False
        mean = total / size
        log_term = math.log(2 * math.log(size) / self.delta)
        n1, s1 = 0, 0.0
        for b, s in buckets[:-1]:
            n1, s1 = n1 + b, s1 + s
            n0, s0 = size - n1, total - s1
            if n0 < 5 or n1 < 5:
                continue
            m = 1 / (1 / n0 + 1 / n1)
            cut = math.sqrt(2 / m * mean * (1 - mean) * log_term) + 2 / (3 * m) * log_term
            if abs(s0 / n0 - s1 / n1) > cut:
                kept, left = [], n1
                for k, row in enumerate(self.rows):
                    here = [s for s in row]
                    take = min(len(here), max(left, 0) // 2**k)
                    kept.append(here[:take])
                    left -= take * 2**k
                self.rows = kept
                return s1 / n1 > s0 / n0
        return False


DETECTORS: dict[str, Callable] = {"ddm": DDM, "eddm": EDDM, "fhddm": FHDDM, "hddm_a": HDDMA, "hddm_w": HDDMW, "adwin": ADWIN}


@dataclass
class Chain:
    """A detector that starts anew after each drift, with a grace period for warnings.

    A warning opens a chain; if no drift follows within `grace` rows without warnings the chain closes. A drift takes
    the start of the open chain as the row of its warning, or its own row."""

    name: str
    grace: int = 100
    seq: int = -1
    warned_at: int = -1
    last_warning: int = -1
    detector: object = None

    def update(self, seq: int, err: int) -> tuple[int, int] | None:
        """(row of the warning, row of the detection) if this row completes a drift."""
        self.detector = self.detector or DETECTORS[self.name]()
        warning, drift = self.detector.update(err)
        if drift:
            found = (self.warned_at if self.warned_at >= 0 else seq), seq
            self.detector, self.warned_at = None, -1
            return found
        if warning:
            self.warned_at = seq if self.warned_at < 0 else self.warned_at
            self.last_warning = seq
        elif self.warned_at >= 0 and seq - self.last_warning > self.grace:
            self.warned_at = -1
        return None


def detect_all(errors: DataFrame, names: Sequence[str], grace: int = 100) -> DataFrame:
    """(detector, stream_id, drift, warned_at, detected_at) of each detector in each stream of (stream_id, seq, err).

    A detector's state depends on every row before, so each stream is one ordered fold, which all detectors share; streams
    run in parallel, and a stream's batches pass through its task one after another, never all at once.
    """
    if unknown := set(names) - set(DETECTORS):
        raise ValueError(f"unknown detectors {sorted(unknown)}; some of {sorted(DETECTORS)}")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, chains, counts = None, {}, {}
        for pdf in batches:
            out = []
            for s, seq, err in zip(pdf["stream_id"], pdf["seq"], pdf["err"], strict=True):
                if s != stream:
                    stream, chains, counts = s, {name: Chain(name, grace) for name in names}, dict.fromkeys(names, 0)
                for name, chain in chains.items():
                    if found := chain.update(int(seq), int(err)):
                        out.append((name, s, counts[name], *found))
                        counts[name] += 1
            yield pd.DataFrame(out, columns=["detector", "stream_id", "drift", "warned_at", "detected_at"])

    ordered = errors.select("stream_id", "seq", "err").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInPandas(fold, "detector string, stream_id string, drift long, warned_at long, detected_at long")


def detect(errors: DataFrame, detector: str = "ddm", grace: int = 100) -> DataFrame:
    """(stream_id, drift, warned_at, detected_at) of one detector (see detect_all)."""
    return detect_all(errors, [detector], grace).drop("detector")


def _around(drifts: DataFrame, key: list[str], rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows of each drift's stream with seq from low to high."""
    theirs = rows.withColumnRenamed("stream_id", "_stream")
    return drifts.select(*key).join(theirs, (F.col("stream_id") == F.col("_stream")) & F.col("seq").between(low, high)).drop("_stream")


def start_by_cusum(errors: DataFrame, drifts: DataFrame, lookback: int = 300, slack: float = 0.1, threshold: float = 1.5) -> DataFrame:
    """Adds `start`: the first of the `lookback` rows before a detection at which the sum of errors above baseline and slack,
    never below 0, exceeds the threshold. The baseline is the mean of their first min(50, quarter) rows, and the sum begins
    behind these; without a crossing the start is there too. Fewer than 20 rows start at their first, detections before row
    50 at 0."""
    key = ["stream_id", "drift", "warned_at", "detected_at"]
    first = F.greatest(F.col("detected_at") - lookback, F.lit(0))
    n = F.col("detected_at") - first
    head = F.least(F.lit(50), F.floor(n / 4))
    near = _around(drifts, key, errors, first, F.col("detected_at") - 1)
    by = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    early = F.col("seq") < first + head
    base = F.avg(F.when(early, F.col("err"))).over(Window.partitionBy(*key))
    rows = near.withColumn("_base", base).withColumn("_total", F.sum(F.when(early, 0.0).otherwise(F.col("err") - F.col("_base") - slack)).over(by))
    rows = rows.withColumn("_s", F.col("_total") - F.least(F.lit(0.0), F.min("_total").over(by))).where(~early & (F.col("_s") > threshold))
    crossed = rows.groupBy(*key).agg(F.min("seq").alias("_crossed"))
    start = F.when(F.col("detected_at") < 50, F.lit(0)).when(n < 20, first).otherwise(F.coalesce("_crossed", first + head))
    return drifts.join(crossed, key, "left").withColumn("start", start.cast("long")).drop("_crossed")


def start_by_threshold(errors: DataFrame, drifts: DataFrame, width: int = 10, factor: float = 1.5, run: int = 20, lookback: int = 300) -> DataFrame:
    """Adds `start`: where `run` consecutive rows before a detection first have a moving error rate over factor x baseline;
    the baseline is the stream's rate in the first 50 rows of the lookback."""
    key = ["stream_id", "drift", "warned_at", "detected_at"]
    by = Window.partitionBy(*key).orderBy("seq").rowsBetween(-(width - 1), 0)
    wide = _around(drifts, key, errors, F.col("detected_at") - lookback - width + 2, F.col("detected_at"))
    rates = wide.withColumn("rate", F.when(F.count("err").over(by) == width, F.avg("err").over(by)))
    near = rates.where(F.col("seq") > F.col("detected_at") - lookback)
    w = Window.partitionBy(*key).orderBy("seq")
    base = F.avg(F.when(F.col("at") <= 50, F.col("err"))).over(Window.partitionBy(*key))
    rows = near.withColumn("at", F.row_number().over(w)).withColumn("base", base).withColumn("high", (F.coalesce(F.col("rate"), F.lit(0.0)) > factor * F.col("base")).cast("int"))
    ahead = w.rowsBetween(0, run - 1)
    rows = rows.withColumn("all", (F.sum("high").over(ahead) == run)).where("all")
    first = rows.groupBy(*key).agg(F.min("seq").alias("start"))
    return drifts.join(first, key, "left").withColumn("start", F.coalesce("start", "warned_at"))


def end_by_peak(errors: DataFrame, drifts: DataFrame, width: int = 20, horizon: int = 200) -> DataFrame:
    """Adds `end`: the last row of the disjoint windows of `width` rows after a detection before whose successor's rate is
    lower; the end of the horizon if it never falls."""
    key = list(drifts.columns)
    near = _around(drifts, key, errors, F.col("detected_at") + 1, F.col("detected_at") + horizon)
    near = near.withColumn("k", F.floor((F.col("seq") - F.col("detected_at") - 1) / width))
    rates = near.groupBy(*key, "k").agg(F.avg("err").alias("rate"), F.max("seq").alias("last"), F.count("*").alias("n")).where(F.col("n") == width)
    falls = rates.withColumn("next", F.lead("rate").over(Window.partitionBy(*key).orderBy("k"))).where("next < rate")
    ends = falls.groupBy(*key).agg(F.min("last").alias("end")).select("stream_id", "drift", "end")
    limits = near.groupBy("stream_id", "drift").agg(F.max("seq").alias("limit"))
    out = drifts.join(ends, ["stream_id", "drift"], "left").join(limits, ["stream_id", "drift"], "left")
    return out.withColumn("end", F.coalesce("end", "limit", "detected_at")).drop("limit")


def end_by_recovery(errors: DataFrame, drifts: DataFrame, width: int = 20, horizon: int = 200, slack: float = 0.1, threshold: float = 1.5) -> DataFrame:
    """Adds `end`: where the sum of baseline minus slack minus error, never below 0, exceeds the threshold after a detection; the
    baseline is the rate of the `width` rows up to it. Otherwise the row before the horizon's last."""
    key = list(drifts.columns)
    near = _around(drifts, key, errors, F.col("detected_at") - width + 1, F.col("detected_at") + horizon)
    every = Window.partitionBy(*key)
    rows = near.withColumn("base", F.avg(F.when(F.col("seq") <= F.col("detected_at"), F.col("err"))).over(every)).where(F.col("seq") > F.col("detected_at"))
    w = every.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(F.col("base") - slack - F.col("err")).over(w))
    rows = rows.withColumn("s", F.col("total") - F.least(F.lit(0.0), F.min("total").over(w)))
    ends = rows.groupBy("stream_id", "drift").agg(F.min(F.when(F.col("s") > threshold, F.col("seq"))).alias("end"), (F.max("seq") - 1).alias("limit"))
    out = drifts.join(ends, ["stream_id", "drift"], "left")
    return out.withColumn("end", F.coalesce("end", "limit", "detected_at")).drop("limit")


def describe(errors: DataFrame, localised: DataFrame, width: int = 50) -> DataFrame:
    """Adds duration and the error rates around the start (+- width / 2), before the detection (width rows) and the largest
    moving rate between start and end."""
    key = list(localised.columns)
    low = F.least(F.col("start") - width // 2, F.col("detected_at") - width)
    near = _around(localised, key, errors, low, F.greatest(F.col("end") + width, F.col("detected_at")))
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(0, width - 1)
    near = near.withColumn("rate", F.when(F.count("err").over(w) == width, F.avg("err").over(w)))
    between = lambda a, b: F.col("seq").between(a, b)
    found = near.groupBy(*key).agg(
        F.avg(F.when(between(F.col("start") - width // 2, F.col("start") + width // 2), F.col("err"))).alias("rate_warning"),
        F.avg(F.when(between(F.col("detected_at") - width + 1, F.col("detected_at")), F.col("err"))).alias("rate_detection"),
        F.max(F.when(between(F.col("start"), F.col("end")), F.col("rate"))).alias("rate_peak"),
    )
    return found.withColumn("duration", F.col("end") - F.col("start"))


def clamped(localised: DataFrame, history: int = 1000) -> DataFrame:
    """Starts no earlier than the errors that were kept before the detection, and none after the detection or the warning."""
    kept = F.greatest(F.col("start"), F.col("detected_at") - history, F.lit(0))
    return localised.withColumn("start", F.least(kept, F.col("detected_at")))


def end_rates(errors: DataFrame, localised: DataFrame, width: int = 50) -> DataFrame:
    """Adds `rate_end`, the error rate around the end (+- width / 2), when the whole stream is known."""
    key = list(localised.columns)
    near = _around(localised, key, errors, F.col("end") - width // 2, F.col("end") + width // 2)
    return localised.join(near.groupBy("stream_id", "drift").agg(F.avg("err").alias("rate_end")), ["stream_id", "drift"], "left")


def start_by_gradient(errors: DataFrame, drifts: DataFrame, width: int = 20, rise: float = 0.01, lookback: int = 300) -> DataFrame:
    """Adds `start`: the first row of the lookback whose moving average of `width` rows rises by more than `rise` to the next."""
    key = ["stream_id", "drift", "warned_at", "detected_at"]
    near = _around(drifts, key, errors, F.col("detected_at") - lookback + 1, F.col("detected_at"))
    by = Window.partitionBy(*key).orderBy("seq")
    rate = lambda i: F.avg("err").over(by.rowsBetween(i, i + width - 1))
    steps = near.withColumn("step", rate(1) - rate(0)).withColumn("held", F.count("err").over(by.rowsBetween(0, width)))
    first = steps.where((F.col("held") == width + 1) & (F.col("step") > rise)).groupBy(*key).agg(F.min("seq").alias("start"))
    return drifts.join(first, key, "left").withColumn("start", F.coalesce("start", "warned_at"))


def error_summary(errors: DataFrame, drifts: DataFrame) -> DataFrame:
    """Rows, accuracy and number of drifts of each stream, with the least, mean and largest duration."""
    e = errors.groupBy("stream_id").agg(F.count("*").alias("n"), (1 - F.avg("err")).alias("accuracy"))
    d = drifts.groupBy("stream_id").agg(F.count("*").alias("drifts"), F.avg("duration").alias("mean_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    return e.join(d, "stream_id", "left").fillna(0, ["drifts"])
