"""Texts as numeric features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer
from pyspark.sql import DataFrame


def fit_tfidf(docs: DataFrame, text: str = "text", vocabulary: int = 5000, name: str = "features") -> PipelineModel:
    """Weights of the most frequent words, up to `vocabulary`, by their rareness among documents."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary),
        IDF(inputCol="_counts", outputCol=name),
    ]).fit(docs)


def tfidf(model: PipelineModel, docs: DataFrame) -> DataFrame:
    return model.transform(docs.fillna("", [model.stages[0].getInputCol()])).drop("_words", "_counts")
