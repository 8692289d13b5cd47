"""Recodes and encodings of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_set(column: str, values: Sequence) -> Column:
    """1 where the column holds one of the values, else 0."""
    return F.coalesce(F.col(column).isin(*values).cast("int"), F.lit(0))


def in_ranges(column: str, limits: Sequence[tuple], rest) -> Column:
    """The name of the first limit that the value is below, else rest."""
    return reduce(lambda case, x: case.when(F.col(column) < x[0], x[1]), limits, F).otherwise(rest)


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values of a fitted column in order, from 0. One row for each category."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def ordinal_encode(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the code of each value; unknown and missing values get -1."""
    keyed = codes.select(F.col("value").alias(column), F.col("code").alias(name))
    return df.join(keyed, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("int"))


def one_hot(df: DataFrame, column: str, domain: Sequence, prefix: str) -> DataFrame:
    """One 0/1 column for each value of a fixed domain."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in domain})


def multi_one_hot(df: DataFrame, columns: Sequence[str], domain: Sequence, prefix: str) -> DataFrame:
    """One 0/1 column for each value, set where any of the columns holds it."""
    held = lambda v: reduce(lambda a, b: a | b, (F.coalesce(F.col(c) == v, F.lit(False)) for c in columns))
    return df.withColumns({f"{prefix}_{v}": held(v).cast("int") for v in domain})


def binary_entropy_weight(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, weight) of 0/1 features: (1 - entropy of the feature within classes, weighted by class size) / ln(classes)."""
    per = df.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    p = F.col("p")
    entropy = F.when((p > 0) & (p < 1), -p * F.log(p) - (1 - p) * F.log(1 - p)).otherwise(0.0)
    long = per.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy())).unpivot(["label", "w"], list(features), "feature", "p")
    return long.groupBy("feature").agg(((1 - F.sum(F.col("w") * entropy)) / F.log(F.count("*").cast("double"))).alias("weight"))


def unscale_line(df: DataFrame, scaled: str, raw: str) -> DataFrame:
    """The line raw = slope * scaled + intercept of least squares, which takes scaled bounds back."""
    return df.agg(F.regr_slope(raw, scaled).alias("slope"), F.regr_intercept(raw, scaled).alias("intercept"))


def drop_constant(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Without the features that have a single value."""
    counts = df.agg(*[F.count_distinct(f).alias(f) for f in features]).first()
    return df.drop(*[f for f in features if counts[f] <= 1])


def typed(column: str) -> Column:
    """The narrowest of long, double and string that reads the text, by name."""
    c = F.col(column)
    return F.when(c.try_cast("long").isNotNull(), "long").when(c.try_cast("double").isNotNull(), "double").otherwise("string")


#: Categories of a column that are spread over columns of their own.
MAX_CATEGORIES = 1000


@dataclass(frozen=True)
class ColumnTransformer:
    """Numbers by mean and deviation, categories as 0/1 columns of all but the first; fitted once, applied to any rows.

    Numbers without spread become 0. Categories that were not there when it was fitted, and missing ones, are 0 in all columns.
    """

    numbers: dict[str, tuple[float, float]]
    categories: dict[str, list]

    @classmethod
    def fit(cls, rows: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> ColumnTransformer:
        """One pass for all numbers and one for all categories, which are few by a check."""
        numbers, categories = {}, {}
        if numeric:
            got = rows.agg(*[F.struct(F.avg(c), F.stddev_pop(c)) for c in numeric]).first()
            numbers = {c: (got[i][0] or 0.0, got[i][1] or 1.0) for i, c in enumerate(numeric)}
        if categorical:
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical)])).alias("p")
            seen = rows.select(pairs).select("p.*").where("v is not null").distinct().limit(MAX_CATEGORIES * len(categorical) + 1).collect()
            for i, c in enumerate(categorical):
                categories[c] = sorted(r.v for r in seen if r.i == i)
                if len(categories[c]) > MAX_CATEGORIES or len(seen) > MAX_CATEGORIES * len(categorical):
                    raise ValueError(f"more than {MAX_CATEGORIES} categories in {c}")
        return cls(numbers, categories)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with their fitted columns replaced: numbers in place, categories as <column>_<category>."""
        put = {c: (F.col(c) - mean) / deviation for c, (mean, deviation) in self.numbers.items()}
        made = {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for c, values in self.categories.items() for v in values[1:]}
        return rows.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns if c not in self.categories], *[x.alias(n) for n, x in made.items()])
