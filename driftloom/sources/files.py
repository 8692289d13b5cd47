"""Files and catalogued tables as datasets of features and a target."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, target: str, features: Sequence[str] | None = None, null_value: str = "") -> DataFrame:
    """Features and `target` of a CSV with a header; features that are not there are ignored."""
    df = spark.read.option("nullValue", null_value).csv(path, header=True, inferSchema=True)
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    keep = [c for c in (features or df.columns) if c in df.columns and c != target]
    return df.select(*keep, F.col(target).alias("target"))


def preview(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """Column names of a CSV and the default target, its last column."""
    names = spark.read.csv(path, header=True).columns
    return names, names[-1] if names else None


def read_arff(spark: SparkSession, path: str, drop: Sequence[str] = (), recode: dict[str, dict[str, float]] | None = None, target: str = "class") -> DataFrame:
    """A plain ARFF file: attribute names from its header, rows from its data part, numbers where all of an attribute are.

    The header is small and read alone; the rows are parsed by Spark's CSV reader.
    """
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    header = lines.where(F.lower("value").startswith("@attribute")).collect()
    names, kinds = [], []
    for r in header:
        m = re.match(r"(?i)@attribute\s+('[^']+'|\"[^\"]+\"|\S+)\s+(.*)", r.value)
        names.append(m[1].strip("'\""))
        kinds.append("double" if re.match(r"(?i)(numeric|real|integer)", m[2]) else "string")
    data = lines.where((F.col("value") != "") & ~F.col("value").rlike("^[@%]"))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = data.select(F.from_csv("value", schema, {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")
    parsed = parsed.select(*[F.col(f"`{n}`").try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
    for column, codes in (recode or {}).items():
        value = F.lit(None).cast("double")
        for old, new in codes.items():
            value = F.when(F.col(column) == old, float(new)).otherwise(value)
        parsed = parsed.withColumn(column, value)
    return parsed.drop(*drop).withColumnRenamed(target, "target")


def read_split(spark: SparkSession, folder: str, name: str, split: str) -> DataFrame:
    """<name>_<split>.csv without its index column."""
    if split not in ("train", "valid", "test"):
        raise ValueError(f"unknown split {split}")
    df = spark.read.csv(f"{folder}/{name}_{split}.csv", header=True, inferSchema=True)
    return df.drop(df.columns[0])


def target_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names without and with "target" in them."""
    return [c for c in df.columns if "target" not in c], [c for c in df.columns if "target" in c]


def stratified_split(df: DataFrame, label: str, sizes: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "valid", "test"), seed: int = 0) -> DataFrame:
    """Adds `split`: exact shares of every class, in a seeded order. Rows of a class are ranked within hash buckets, which are
    offset by their sizes, so a large class is no single task's."""
    if abs(sum(sizes) - 1) > 1e-9:
        raise ValueError("sizes must sum to 1")
    keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns)).withColumn("_b", F.shiftright("_h", 56))
    counts = keyed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)
    counts = counts.select(label, "_b", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_n").over(by).alias("_all"))
    placed = keyed.join(counts, [label, "_b"]).withColumn("_at", (F.col("_off") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))) / F.col("_all"))
    split, edge = F.lit(names[-1]), 1.0
    for name, size in list(zip(names, sizes, strict=True))[-2::-1]:
        edge -= sizes[names.index(name) + 1]
        split = F.when(F.col("_at") <= edge + 1e-12, name).otherwise(split)
    return placed.withColumn("split", split).drop("_h", "_b", "_off", "_all", "_at")


class Catalog:
    """Datasets saved as tables of a database, with target and selected features as table properties."""

    def __init__(self, spark: SparkSession, database: str = "drift_datasets"):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def _name(self, name: str) -> str:
        return f"{self.database}.{re.sub(r'[^A-Za-z0-9_]', '_', name)}"

    def save(self, name: str, df: DataFrame, target: str, features: Sequence[str] | None = None) -> None:
        df.write.mode("overwrite").saveAsTable(self._name(name))
        chosen = ",".join(features or [c for c in df.columns if c != target])
        self.spark.sql(f"ALTER TABLE {self._name(name)} SET TBLPROPERTIES ('target' = '{target}', 'features' = '{chosen}')")

    def list(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def info(self, name: str) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._name(name)}").collect()}

    def load(self, name: str) -> DataFrame:
        info, df = self.info(name), self.spark.table(self._name(name))
        return df.select(*[c for c in info["features"].split(",") if c in df.columns and c != info["target"]], F.col(info["target"]).alias("target"))

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
