"""Datasets by name: generated streams, named real streams in files, and tables that were saved before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generators
from .files import Catalog, read_arff

#: Carriers and airports by size; all others are of group 0.
LARGE_CARRIERS = ("UA", "AA", "DL", "WN", "US", "CO", "B6", "AS")
REGIONAL_CARRIERS = ("MQ", "OH", "EV", "9E", "YV", "OO", "XE")
LARGE_AIRPORTS = ("ATL", "ORD", "DFW", "DEN", "LAX", "JFK", "SFO", "CLT", "LAS", "PHX")
MEDIUM_AIRPORTS = ("SEA", "MIA", "IAH", "MSP", "DTW", "BOS", "PHL", "LGA", "EWR", "BWI")


def read_airline(spark: SparkSession, path: str) -> DataFrame:
    """Flights of an ARFF file with carriers in three groups and whole-number days; the target is whether there was a delay.

    The airports, which the survey's stream recodes and then drops, do not stay.
    """
    rows = read_arff(spark, path, drop=("AirportFrom", "AirportTo"), target="Delay")
    group = F.when(F.col("Airline").isin(*LARGE_CARRIERS), 2).when(F.col("Airline").isin(*REGIONAL_CARRIERS), 1).otherwise(0)
    return rows.withColumns({"Airline": group, "DayOfWeek": F.col("DayOfWeek").cast("int"), "target": F.col("target").cast("int")})


def airport_group(column: str) -> Column:
    """2 for the largest airports, 1 for medium ones, else 0."""
    return F.when(F.col(column).isin(*LARGE_AIRPORTS), 2).when(F.col(column).isin(*MEDIUM_AIRPORTS), 1).otherwise(0)


def read_sensor(spark: SparkSession, path: str) -> DataFrame:
    """Sensor readings without their minute; the target is the sensor as a whole number."""
    rows = read_arff(spark, path, drop=("rcdminutes",))
    return rows.withColumn("target", F.col("target").cast("int"))


def read_pakdd(spark: SparkSession, path: str) -> DataFrame:
    """Credit cases; the target is a whole number, which the file may hold as a decimal one."""
    return read_arff(spark, path).withColumn("target", F.col("target").cast("double").cast("int"))


def read_poker(spark: SparkSession, path: str) -> DataFrame:
    """Poker hands as comma-separated numbers without a header: suit and rank of five cards, then the hand."""
    names = [f"{kind}{i}" for i in range(1, 6) for kind in ("S", "C")]
    return spark.read.csv(path, schema=", ".join(f"{c} int" for c in [*names, "target"]))


REAL: dict[str, Callable[[SparkSession, str], DataFrame]] = {"airline": read_airline, "poker": read_poker, "sensor": read_sensor, "pakdd": read_pakdd}


def first_features(rows: DataFrame, n: int) -> DataFrame:
    """The columns X1 to Xn and the target, if there is one; no rows if one of the columns is missing."""
    names = [f"X{i}" for i in range(1, n + 1)]
    rest = [c for c in ("target",) if c in rows.columns]
    if missing := [c for c in names if c not in rows.columns]:
        kinds = [f"{c} {'double' if c in missing else rows.schema[c].dataType.simpleString()}" for c in [*names, *rest]]
        return rows.sparkSession.createDataFrame([], ", ".join(kinds))
    return rows.select(*names, *rest)


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in an order that depends on the seed and on what the rows hold, not on how they are stored."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)


@dataclass(frozen=True)
class Dataset:
    """A named source; load() gives its rows, features and a `target`."""

    name: str
    kind: str
    load: Callable[[], DataFrame]


class Registry:
    """Built-in streams, files of real streams and saved tables under one set of names.

    `files` maps names of REAL to paths. Saved tables are those of the catalog when the registry was last loaded; one with
    the name of a built-in stream takes its place.
    """

    def __init__(self, spark: SparkSession, database: str = "drift_datasets", files: dict[str, str] | None = None, seed: int = 42):
        self.spark, self.catalog, self.files, self.seed = spark, Catalog(spark, database), dict(files or {}), seed
        if unknown := set(self.files) - set(REAL):
            raise ValueError(f"unknown streams {sorted(unknown)}; some of {sorted(REAL)}")
        self.reload()

    def reload(self) -> None:
        """Look for saved tables again."""
        found = {name: Dataset(name, "generated", lambda make=make: make(self.spark, 5000, 5000, seed=self.seed)) for name, make in generators.TWO_BLOCKS.items()}
        found |= {name: Dataset(name, "generated", lambda name=name: generators.named(self.spark, name, self.seed)) for name in generators.NAMED}
        found |= {name: Dataset(name, "file", lambda name=name, path=path: REAL[name](self.spark, path)) for name, path in self.files.items()}
        found |= {name: Dataset(name, "saved", lambda name=name: self.catalog.load(name)) for name in self.catalog.list()}
        self.datasets = found

    def get(self, name: str) -> Dataset | None:
        return self.datasets.get(name)

    def all(self) -> list[Dataset]:
        return list(self.datasets.values())

    def save(self, name: str, rows: DataFrame, target: str, features: Sequence[str] | None = None) -> None:
        """Save a table under a name, which is known at once."""
        self.catalog.save(name, rows, target, features)
        self.reload()

    def delete(self, name: str) -> None:
        self.catalog.delete(name)
        self.reload()
