"""Classifiers by preset name, their scores, and where they are kept."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Options of each preset; callers override single ones.
PRESETS: dict[str, dict] = {
    "forest": {"numTrees": 20, "maxDepth": 6},
    "forest_large": {"numTrees": 100, "maxDepth": 10},
    "tree": {"maxDepth": 6},
    "stump": {"maxDepth": 1, "maxBins": 256},
    "logistic": {"maxIter": 100},
    "bayes": {"modelType": "gaussian"},
    "svm": {"maxIter": 100, "regParam": 0.001},
    "mlp": {"hidden": (10,), "maxIter": 200},
    "mlp_deep": {"hidden": (32, 16, 8), "maxIter": 300},
}
_KINDS = {
    "forest": RandomForestClassifier, "tree": DecisionTreeClassifier, "stump": DecisionTreeClassifier,
    "logistic": LogisticRegression, "bayes": NaiveBayes, "svm": LinearSVC, "mlp": MultilayerPerceptronClassifier,
}


def fit(rows: DataFrame, features: list[str], label: str = "label", preset: str = "forest", seed: int = 0, **options) -> PipelineModel:
    """A model of labels 0, 1, ... by one of PRESETS (svm: 0 and 1 only). All see standardised features."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    kind = _KINDS[preset.split("_")[0]]
    options = PRESETS[preset] | options
    if kind is MultilayerPerceptronClassifier:
        classes = int(rows.agg(F.max(label)).first()[0]) + 1
        options["layers"] = [len(features), *options.pop("hidden"), max(classes, 2)]
    if hasattr(kind, "seed"):
        options["seed"] = seed
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    return Pipeline(stages=[*stages, kind(featuresCol="_x", labelCol=label, **options)]).fit(rows)


def with_classes(model: PipelineModel, rows: DataFrame, name: str = "predicted") -> DataFrame:
    """Adds the model's class as `name` and the probabilities of all classes as `name`_p. All rows and columns stay.

    A margin classifier has no probabilities; its margin's logistic curve stands in for that of class 1.
    """
    scored = model.transform(rows)
    if "probability" in scored.columns:
        shares = vector_to_array("probability")
    else:
        one = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        shares = F.array(1 - one, one)
    return scored.select(*rows.columns, F.col("prediction").cast("int").alias(name), shares.alias(f"{name}_p"))


def accuracy(model: PipelineModel, rows: DataFrame, label: str = "label") -> DataFrame:
    return with_classes(model, rows, "_class").agg(F.count("*").alias("rows"), F.avg((F.col("_class") == F.col(label)).cast("double")).alias("accuracy"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
