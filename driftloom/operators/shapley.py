"""Shapley values for any number of features, by a weighted fit over coalitions of features."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Numbers in the mixed rows that a task scores at once.
MIXED = 2_000_000
#: Rows on either side whose different values meet in one block.
BLOCK = 1_024


def coalitions(d: int, budget: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Proper, non-empty coalitions of d features as rows of a mask, and the weight of each in the fit.

    Sizes are taken from both ends inwards. A size whose coalitions all fit into the budget is listed whole, with the
    kernel's weights; what is left of the budget is drawn in pairs of a coalition and its complement from the other sizes,
    which share the weight that remains. With 2**d - 2 or more, all coalitions are listed and the fit is exact.
    """
    if d < 2:
        return np.zeros((0, d), bool), np.zeros(0)
    whole = lambda s: (d - 1) / (s * (d - s))  # weight of all coalitions of one size
    masks: list[np.ndarray] = []
    weights: list[float] = []
    size = 1
    while size <= d // 2:
        both = size != d - size
        count = math.comb(d, size)
        if count * (1 + both) > budget - len(masks):
            break
        for chosen in combinations(range(d), size):
            mask = np.zeros(d, bool)
            mask[list(chosen)] = True
            for m in (mask, ~mask) if both else (mask,):
                masks.append(m)
                weights.append(whole(size) / count)
        size += 1
    open_ = list(range(size, d // 2 + 1))
    if open_ and len(masks) + 2 <= budget:
        share = np.array([whole(s) * (1 if s == d - s else 2) for s in open_])
        rng, drawn = np.random.default_rng(seed), {}
        for s in rng.choice(open_, (budget - len(masks)) // 2, p=share / share.sum()):
            mask = np.zeros(d, bool)
            mask[rng.choice(d, s, replace=False)] = True
            for m in (mask, ~mask):
                drawn[m.tobytes()] = drawn.get(m.tobytes(), 0) + 1
        each = share.sum() / sum(drawn.values())
        masks += [np.frombuffer(k, bool) for k in drawn]
        weights += [n * each for n in drawn.values()]
    return np.array(masks).reshape(-1, d), np.array(weights)


def solution(masks: np.ndarray, weights: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(M, u): the values of a row are M y + u (total - sum of M y), for its gains y over the empty coalition.

    They minimise the weighted squared error of sums of values against gains, given that all values sum to `total`. All rows
    share the coalitions, so the normal equations (d x d) are solved once.
    """
    if not len(masks):
        return np.zeros((d, 0)), np.full(d, 1 / d)
    z = masks.astype(float)
    inverse = np.linalg.pinv(z.T @ (z * weights[:, None]), hermitian=True)
    u = inverse.sum(1)
    return inverse @ (z.T * weights), u / u.sum()


def kernel_shap(score: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, d: int, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(row_id, base, phi) for rows (row_id, x), where x and phi are arrays over d features.

    score adds to a table with x the column `value` that is explained; a feature outside a coalition takes its value from
    background rows (x, and n where a row stands for n), over which values are averaged. base is the mean score of the
    background; base and phi sum to the row's own score. Both sides may be as many as wanted: what a coalition takes from rows
    and what it leaves to the background are collapsed to different values, which meet in blocks, so a coalition scores the
    product of its different values on either side; where all rows differ in all features that is their square. Coalitions are
    few by choice of the caller. Null features give null values.
    """
    masks, weights = coalitions(d, 2 * d + 2048 if budget is None else budget, seed)
    solve, spread = solution(masks, weights, d)
    spark = rows.sparkSession
    every = [*masks.tolist(), [True] * d, [False] * d]
    listed = F.broadcast(spark.createDataFrame([(i, m) for i, m in enumerate(every)], "_mask int, _in array<boolean>"))  # bounded by an argument
    part = lambda taken: F.transform("_in", lambda t, i: F.when(t if taken else ~t, F.get("x", i)))
    masked = rows.select("row_id", "x").crossJoin(listed).select("row_id", "_mask", "_in", part(True).alias("_own"))
    n = F.col("n") if "n" in background.columns else F.lit(1)
    left = background.select("x", n.cast("long").alias("_n")).crossJoin(listed).groupBy("_mask", part(False).alias("_other")).agg(F.sum("_n").alias("_n"))
    wide, high = (max(1, -(-side.count() // BLOCK)) for side in (rows, background))
    block = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    taken = masked.groupBy("_mask", "_own").agg(F.first("_in").alias("_in")).withColumn("_i", block("_own", wide)).withColumn("_j", each(high))
    cells = taken.join(left.withColumn("_j", block("_other", high)).withColumn("_i", each(wide)), ["_mask", "_i", "_j"])
    mixed = F.transform("_in", lambda t, i: F.when(t, F.get("_own", i)).otherwise(F.get("_other", i)))
    scored = score(cells.select("_mask", "_own", "_n", mixed.alias("x")))
    mean = F.sum(F.col("value") * F.col("_n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("_n")))
    means = masked.select("row_id", "_mask", "_own").join(scored.groupBy("_mask", "_own").agg(mean.alias("_v")), ["_mask", "_own"])
    listed_means = means.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_mask", F.coalesce("_v", F.lit(float("nan"))).alias("v")))), lambda s: s["v"]).alias("vs"))  # one number for each coalition

    @pandas_udf("base double, phi array<double>")
    def solved(values: pd.Series) -> pd.DataFrame:
        v = np.array(values.tolist()).reshape(len(values), -1)
        base, total = v[:, -1], v[:, -2] - v[:, -1]
        phi = (v[:, :-2] - base[:, None]) @ solve.T
        phi += np.outer(total - phi.sum(1), spread)
        return pd.DataFrame({"base": base, "phi": list(phi)})

    return listed_means.select("row_id", solved("vs").alias("s")).select("row_id", "s.base", "s.phi")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """The first d numbers of each list as a row; what is null or missing is NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count == 0 and (sizes == d).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    out = np.full((len(column), d), np.nan)
    for to, found in zip(out, column.to_pylist(), strict=True):
        given = (found or [])[:d]
        to[: len(given)] = np.array(given, float)
    return out


def kernel_shap_arrays(score: Callable[[np.ndarray], np.ndarray], rows: DataFrame, background: DataFrame, d: int, budget: int | None = None, seed: int = 0) -> DataFrame:
    """What kernel_shap gives, for a score that numpy can take: a matrix of rows and d features -> one number for each row.

    A task mixes, scores and solves its rows a few at a time, so nothing is shuffled but the rows, which are dealt evenly.
    Background rows go to all tasks with the function. Their scores of NaN, as nulls give, are left out of means. Null features
    give null values. Each row has values of its own, also of equal row_id.
    """
    masks, weights = coalitions(d, 2 * d + 2048 if budget is None else budget, seed)
    solve, spread = solution(masks, weights, d)
    taken = np.vstack([masks, np.ones((1, d), bool), np.zeros((1, d), bool)])[:, None, :]
    held = background.select(F.col("x").cast("array<double>")).collect()  # small by choice of the caller
    back = _matrix(pa.array([r[0] for r in held], pa.list_(pa.float64())), d)
    at_once = max(1, MIXED // max(1, taken.size * len(back)))
    id_type = rows.schema["row_id"].dataType.simpleString()

    def values(x: np.ndarray) -> np.ndarray:
        mixed = np.where(taken, x[:, None, None, :], back)
        v = np.asarray(score(mixed.reshape(-1, d)), float).reshape(mixed.shape[:-1])
        there = ~np.isnan(v)
        if there.all():
            return v.mean(2)
        with np.errstate(invalid="ignore"):
            return np.where(there, v, 0.0).sum(2) / there.sum(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x) or not len(back):
                continue
            v = np.vstack([values(x[i : i + at_once]) for i in range(0, len(x), at_once)])
            base, total = v[:, -1], v[:, -2] - v[:, -1]
            phi = (v[:, :-2] - base[:, None]) @ solve.T
            phi += np.outer(total - phi.sum(1), spread)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * d + 1, d), pa.int32()), pa.array(phi.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, from_pandas=True), lists], ["row_id", "base", "phi"])

    dealt = rows.select("row_id", F.col("x").cast("array<double>").alias("x")).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"row_id {id_type}, base double, phi array<double>")


def probability_of(model: Model, vector: str = "_x", label: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A score for kernel_shap: the probability of one class by a model that reads the column `vector`."""

    def score(cells: DataFrame) -> DataFrame:
        scored = model.transform(cells.withColumn(vector, array_to_vector("x")))
        return scored.select(*cells.columns, vector_to_array("probability")[label].alias("value"))

    return score


def importances(values: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance, deviation): mean and population deviation of the absolute values of each feature; a row stands for n
    where values have that column."""
    n = F.col("n") if "n" in values.columns else F.lit(1)
    each = values.select(n.alias("_n"), F.posexplode("phi").alias("_at", "_phi")).select("_at", "_n", F.abs("_phi").alias("_phi")).where("_phi is not null")
    mean = lambda c: F.sum(c * F.col("_n")) / F.sum("_n")
    means = each.groupBy("_at").agg(mean(F.col("_phi")).alias("importance"))  # a row for each feature
    found = each.join(F.broadcast(means), "_at").groupBy("_at", "importance").agg(F.sqrt(mean((F.col("_phi") - F.col("importance")) ** 2)).alias("deviation"))
    names = F.array(*[F.lit(f) for f in features])
    return found.select(F.get(names, F.col("_at")).alias("feature"), "importance", "deviation")
