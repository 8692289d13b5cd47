"""Where the decision boundaries of two blocks disagree, as maps and rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize

from .classifiers import with_classes


@dataclass
class Projector:
    """Plane of the two directions with most variance; two features pass through. The inverse is linear."""

    features: list[str]
    mean: np.ndarray
    axes: np.ndarray  # two rows

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str]) -> Projector:
        if len(features) == 2:
            return cls(features, np.zeros(2), np.eye(2))
        moments = rows.agg(*[F.avg(f) for f in features], *[F.covar_pop(a, b) for i, a in enumerate(features) for b in features[i:]]).first()
        d = len(features)
        cov, at = np.zeros((d, d)), d
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = moments[at]
                at += 1
        _, vectors = np.linalg.eigh(cov)
        axes = vectors[:, ::-1][:, :2].T
        axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
        return cls(features, np.array(moments[:d]), axes)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds u and v."""
        line = lambda a: sum((F.lit(float(w)) * (F.col(f) - float(m)) for w, f, m in zip(a, self.features, self.mean, strict=True)), F.lit(0.0))
        return rows.withColumns({"u": line(self.axes[0]), "v": line(self.axes[1])})

    def inverse(self, rows: DataFrame) -> DataFrame:
        """Adds the features of points (u, v)."""
        return rows.withColumns({f: F.col("u") * float(self.axes[0][i]) + F.col("v") * float(self.axes[1][i]) + float(self.mean[i]) for i, f in enumerate(self.features)})


def classifier(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 6, seed: int = 0):
    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))


def label_points(model, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    """Adds the class and its probability under `name` by a forest or any model of `classifiers`."""
    if isinstance(model, PipelineModel):
        out = with_classes(model, rows, name)
        return out.withColumns({name: F.col(name).cast("double"), f"{name}_p": F.array_max(f"{name}_p")})
    out = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    return out.withColumn(f"{name}_p", F.array_max(vector_to_array("probability"))).withColumnRenamed("prediction", name).drop("_x", "rawPrediction", "probability")


def grid(rows: DataFrame, projector: Projector, size: int = 200, margin: float = 0.1) -> DataFrame:
    """size x size points (cell, u, v, features) over the projected rows with a margin, as arithmetic over a range."""
    b = projector.transform(rows).agg(F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    (u0, u1), (v0, v1) = ((lo - margin * (hi - lo), hi + margin * (hi - lo)) for lo, hi in ((b[0], b[1]), (b[2], b[3])))
    points = rows.sparkSession.range(size * size).select(
        F.col("id").alias("cell"), (F.lit(u0) + (F.col("id") % size) * ((u1 - u0) / (size - 1))).alias("u"),
        (F.lit(v0) + F.floor(F.col("id") / size) * ((v1 - v0) / (size - 1))).alias("v"),
    )
    return projector.inverse(points)


def disagreement_rate(rows: DataFrame, features: list[str], before, after) -> DataFrame:
    """Share of rows to which the models of the two blocks give different classes."""
    both = label_points(after, label_points(before, rows, features, "c0"), features, "c1")
    return both.agg(F.avg((F.col("c0") != F.col("c1")).cast("double")).alias("rate"))


def disagreement_map(rows: DataFrame, features: list[str], before, after, size: int = 200, projector=None) -> DataFrame:
    """The grid with the class and confidence of both models and whether they disagree, in the plane of principal axes or of a given
    projector, such as local_affine.LocalAffine."""
    points = grid(rows, projector or Projector.fit(rows, features), size)
    both = label_points(after, label_points(before, points, features, "c0"), features, "c1")
    return both.withColumn("differ", (F.col("c0") != F.col("c1")).cast("int"))


def _leaves(tree) -> list[tuple[list[tuple[int, str, float]], float]]:
    """(conditions (feature, <= or >, threshold), class) of each leaf of a tree with continuous features, left to right."""
    out = []

    def walk(node, conditions: list) -> None:
        if node.numDescendants() == 0:
            out.append((conditions, node.prediction()))
            return
        split = node.split()
        at = split.featureIndex(), split.threshold()
        walk(node.leftChild(), [*conditions, (at[0], "<=", at[1])])
        walk(node.rightChild(), [*conditions, (at[0], ">", at[1])])

    walk(tree._call_java("rootNode"), [])
    return out


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules with their place, the largest coverage first, then the most samples."""
    return rules.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), F.desc("samples"), "rule")))  # a few rules


def unscaled(rules: DataFrame, marked: DataFrame, features: list[str], shift: dict[str, float], scale: dict[str, float]) -> DataFrame:
    """(rule, feature, low, high, share of the map): the box of each rule's points in the units of the table."""
    total = marked.agg(F.count("*").alias("_all"))
    ends = [f(F.col(x) * scale[x] + shift[x]).alias(f"{n}_{x}") for x in features for n, f in (("low", F.min), ("high", F.max))]
    boxes = marked.where("rule > 0").groupBy("rule").agg(F.count("*").alias("_n"), *ends).crossJoin(total)  # one row
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"low_{x}").alias("low"), F.col(f"high_{x}").alias("high")) for x in features])).alias("s")
    return boxes.join(rules.select("rule"), "rule", "left_semi").select("rule", sides, (F.col("_n") / F.col("_all")).alias("area")).select("rule", "s.*", "area")


def drift_rules(marked: DataFrame, features: list[str], depth: int = 4, min_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Rules of a small tree over `differ` (balanced classes), and marked rows with their rule (0: stable).

    A leaf is a rule if differing points, weighted to balance, are the larger part of it. Bounds are met with the features'
    range. Columns: rule, text, samples, coverage (of all differing points), confidence. The tree has 2**depth leaves at most,
    which the driver turns into one conditional expression.
    """
    marked = materialize(marked, "marked-map")  # scored once, read by the tree, its limits and its rules
    total, hits = marked.agg(F.count("*"), F.sum("differ")).first()
    if not hits:
        spark = marked.sparkSession
        return spark.createDataFrame([], "rule int, text string, samples long, coverage double, confidence double"), marked.withColumn("rule", F.lit(0))
    weight = F.when(F.col("differ") == 1, total / (2.0 * hits)).otherwise(total / (2.0 * max(total - hits, 1)))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(marked.withColumn("_w", weight))
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="differ", weightCol="_w", maxDepth=depth, minInstancesPerNode=max(1, int(min_share * total)), seed=0).fit(data)
    limits = marked.agg(*[F.struct(F.min(f), F.max(f)).alias(f) for f in features]).first()
    case, texts = F.lit(0), {}
    for conditions, label in _leaves(tree):
        if label != 1.0:
            continue
        number, test = len(texts) + 1, F.lit(True)
        bounds = {}
        for i, op, value in conditions:
            test = test & (F.col(features[i]) <= value if op == "<=" else F.col(features[i]) > value)
            lo, hi = bounds.get(i, tuple(limits[features[i]]))
            bounds[i] = (lo, min(hi, value)) if op == "<=" else (max(lo, value), hi)
        texts[number] = " AND ".join(f"{lo:.4g} < {features[i]} <= {hi:.4g}" for i, (lo, hi) in sorted(bounds.items())) or "everywhere"
        case = F.when(test, number).otherwise(case)
    placed = marked.withColumn("rule", case)
    names = F.element_at(F.create_map(*[x for k, v in (texts or {-1: ""}).items() for x in (F.lit(k), F.lit(v))]), F.col("rule"))
    rules = placed.where("rule > 0").groupBy("rule").agg(F.count("*").alias("samples"), (F.sum("differ") / F.lit(hits)).alias("coverage"), F.avg(F.col("differ").cast("double")).alias("confidence"))
    return rules.select("rule", names.alias("text"), "samples", "coverage", "confidence"), placed
