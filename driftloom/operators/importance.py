"""Which features a model leans on, and how that differs between blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from . import shapley

LIME_ROWS = 100
#: Rows of the largest partition that a fit takes as it is.
PART_ROWS = 1_000_000


def fit(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 6, seed: int = 0) -> Model:
    """A random forest of all rows. Its fit keeps each partition's rows in one piece, so partitions above PART_ROWS are dealt anew."""
    rows = rows.select(label, *features)
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) > PART_ROWS:
        rows = rows.repartition(-(-sizes[1] // PART_ROWS))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def score(model: Model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds `prediction` and `p1`, the probability of class 1."""
    data = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    return data.withColumn("p1", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability")


def _cut(runs: DataFrame, size: int) -> DataFrame:
    """Runs (_lo, _hi) cut at multiples of `size`; `_block` is the multiple. A long run is cut in two steps, so no array is long."""
    first, last, step = F.floor(F.col("_lo") / size), F.floor((F.col("_hi") - 1) / size), 4096
    coarse = runs.withColumn("_block", F.explode(F.sequence(first, last, F.lit(step).cast("long")))).withColumn("_last", F.least(F.col("_block") + step - 1, last))
    fine = coarse.withColumn("_block", F.explode(F.sequence("_block", "_last"))).drop("_last")
    return fine.withColumns({"_lo": F.greatest("_lo", F.col("_block") * size), "_hi": F.least("_hi", (F.col("_block") + 1) * size)})


def permutation_importance(model: Model, rows: DataFrame, features: list[str], label: str = "label", repeats: int = 30, seed: int = 0) -> DataFrame:
    """(feature, importance, deviation): mean and population deviation of the fall of accuracy when a feature is shuffled.

    Rows are put in hash order of their features; for each repeat a feature takes the value of the row a random offset away.
    Rows with equal features follow each other, so they are kept as one run with counts of its labels: what is moved and scored
    is where runs meet shifted runs, at most about four times the different rows for each repeat. Which of a run's rows meets
    which value is open; its mean over all orders counts. Runs meet in blocks of positions that hold one run on average.
    """
    counted = rows.groupBy(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_label")).agg(F.count("*").alias("_n"))
    known = F.when(F.col("_label").isNotNull(), F.struct("_label", "_n"))
    runs = materialize(counted.groupBy(*features).agg(F.sum("_n").alias("_size"), F.map_from_entries(F.collect_list(known)).alias("_labels")), "runs")
    n, different = (x or 0 for x in runs.agg(F.sum("_size"), F.count("*")).first())
    keyed = runs.withColumn("_h", F.xxhash64(F.lit(seed), *features)).withColumn("_b", F.shiftright("_h", 54))
    counts = keyed.groupBy("_b").agg(F.sum("_size").alias("_n"))
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # 1024 buckets
    ends = F.col("_off") + F.sum("_size").over(Window.partitionBy("_b").orderBy("_h", *features).rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.join(F.broadcast(counts), "_b").withColumn("_hi", ends).withColumn("_lo", F.col("_hi") - F.col("_size")).drop("_h", "_b", "_off")
    placed = materialize(placed, "placed")
    right = F.coalesce(F.try_element_at("_labels", F.col("prediction")), F.lit(0)) / F.col("_size")
    labelled = F.aggregate(F.map_values("_labels"), F.lit(0).cast("long"), lambda s, x: s + x)
    rights, total = score(model, placed, features).agg(F.sum(right * F.col("_size")), F.sum(labelled)).first()
    base = rights / total if total else None
    rng = np.random.default_rng(seed)
    offsets = [(f, r, int(rng.integers(1, max(n, 2)))) for f in features for r in range(repeats)]
    plan = rows.sparkSession.createDataFrame(offsets, "_feature string, _repeat int, _offset long")  # repeats x features rows
    size = -(-n // max(different, 1)) or 1
    twice = placed.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(n).cast("long")))).withColumns({"_lo": F.col("_lo") + F.col("_turn"), "_hi": F.col("_hi") + F.col("_turn")})
    givers = _cut(placed, size).crossJoin(F.broadcast(plan)).withColumn("_by", F.lit(n) - F.pmod("_offset", F.lit(max(n, 1))))
    value = F.coalesce(*[F.when(F.col("_feature") == f, F.col(f)) for f in features])
    givers = givers.select("_feature", "_repeat", value.alias("_value"), (F.col("_lo") + F.col("_by")).alias("_from"), (F.col("_hi") + F.col("_by")).alias("_to"))
    givers = givers.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))  # two blocks at most
    shared = F.least("_hi", "_to") - F.greatest("_lo", "_from")
    mixed = _cut(twice.drop("_turn"), size).join(givers, "_block").withColumn("_shared", shared).where("_shared > 0")
    mixed = mixed.withColumns({f: F.when(F.col("_feature") == f, F.col("_value")).otherwise(F.col(f)) for f in features})
    falls = score(model, mixed, features).groupBy("_feature", "_repeat").agg((F.lit(base) - F.sum(right * F.col("_shared")) / F.lit(total)).alias("fall"))
    return falls.groupBy(F.col("_feature").alias("feature")).agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("deviation"))


def _sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns)).limit(n)


def shap_importance(model: Model, rows: DataFrame, features: list[str], background: int | None = None, sample: int | None = None, seed: int = 0, budget: int | None = None) -> DataFrame:
    """(feature, importance, deviation): mean and population deviation of the absolute Shapley value of each feature for class 1
    over all rows against all rows, or over `sample` and against `background` of them where these are given.

    Rows of equal features are explained once. Values come from a weighted fit over coalitions of any number of features (see
    shapley.kernel_shap), which is exact as long as all coalitions are within the budget.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    some = lambda n, s: rows.select(*features) if n is None else _sample(rows.select(*features), n, s)
    counted = lambda n, s: some(n, s).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    few = materialize(counted(sample, seed).withColumn("row_id", F.monotonically_increasing_id()), "explained")  # row numbers are given once
    back = few if background is None and sample is None else materialize(counted(background, seed + 1), "background")
    values = materialize(shapley.kernel_shap(shapley.probability_of(model), few, back, len(features), budget, seed).join(few.select("row_id", "n"), "row_id"), "explained-values")
    return shapley.importances(values, features)


def lime_importance(model: Model, rows: DataFrame, features: list[str], n_rows: int = LIME_ROWS, perturbations: int = 200, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """Mean absolute weight of each feature in local weighted ridge fits around n_rows rows.

    Perturbations are standard normal in units of each feature's deviation, weighted by an exponential kernel.
    """
    stats = rows.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    sd = {f: stats[f] or 1.0 for f in features}
    x = materialize(_sample(rows.select(*features), n_rows, seed).withColumn("row", F.monotonically_increasing_id()), "explained")
    noise = rows.sparkSession.range(perturbations).select(F.col("id").alias("k"))
    u = lambda f, s: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(f + s), "row", "k"), 11).cast("double") + 1) / (2.0**53 + 1)
    cells = x.crossJoin(F.broadcast(noise)).withColumns({f"z_{f}": F.sqrt(-2 * F.log(u(f, "a"))) * F.cos(2 * math.pi * u(f, "b")) for f in features})
    cells = cells.withColumns({f: F.col(f) + F.col(f"z_{f}") * sd[f] for f in features})
    scored = score(model, cells, features).select("row", "p1", *[f"z_{f}" for f in features])
    width = 0.75 * math.sqrt(len(features))

    def fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y = pdf[[f"z_{f}" for f in features]].to_numpy(), pdf["p1"].to_numpy()
        w = np.exp(-(z**2).sum(1) / width**2)
        zc, yc = z - (w @ z) / w.sum(), y - (w @ y) / w.sum()
        beta = np.linalg.solve(zc.T @ (zc * w[:, None]) + ridge * np.eye(len(features)), zc.T @ (w * yc))
        return pd.DataFrame({"feature": features, "weight": np.abs(beta)})

    return scored.groupBy("row").applyInPandas(fit_rows, "feature string, weight double").groupBy("feature").agg(F.avg("weight").alias("importance"))


METHODS = {"permutation": permutation_importance, "shap": shap_importance, "lime": lime_importance}


def importance(method: str, model: Model, rows: DataFrame, features: list[str], **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {sorted(METHODS)}")
    return METHODS[method](model, rows, features, **options).select("feature", "importance")


def drift_importance(rows: DataFrame, features: list[str], method: str = "permutation", with_label: bool = False, **options) -> tuple[DataFrame, float]:
    """Importance of features for telling the block after from the block before, and the accuracy on the same rows.

    With the label as a further input this looks for concept drift; the label's own importance is left out.
    """
    data = rows.withColumn("_period", (F.col("block") == "after").cast("int"))
    used = [*features, "label"] if with_label else list(features)
    model = fit(data, used, "_period")
    data = data.select(*used, F.col("_period").alias("period"))
    accuracy = score(model, data, used).agg(F.avg((F.col("prediction") == F.col("period")).cast("double"))).first()[0]
    renamed = data.withColumnRenamed("period", "target") if method == "permutation" else data
    found = importance(method, model, renamed, used, **({"label": "target"} if method == "permutation" else {}), **options)
    return found.where(F.col("feature") != "label") if with_label else found, accuracy


def predictive_shift(rows: DataFrame, features: list[str], method: str = "permutation", **options) -> DataFrame:
    """Importance of each feature in a model of each block, and the difference."""
    sides = {}
    for b in ("before", "after"):
        part = rows.where(F.col("block") == b).drop("block")
        sides[b] = importance(method, fit(part, features), part, features, **options).withColumnRenamed("importance", b)
    return sides["before"].join(sides["after"], "feature").withColumn("shift", F.col("after") - F.col("before"))
