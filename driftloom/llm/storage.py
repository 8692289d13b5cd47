"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/driftloom-checkpoints"
    return base.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and later readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._driftloom_path = path
    return back


#: What a Python worker keeps for later tasks of the same kind, by name.
KEPT: dict[str, object] = {}


def give_back(keep: str = "") -> None:
    """Drop what this Python worker keeps for other kinds of tasks, and return freed memory to the machine.

    Workers live on after a task and would hold both; an executor has more of them than tasks, and all take turns. So
    functions call this after each batch, when nothing of theirs refers to it any more.
    """
    for name in [k for k in KEPT if k != keep]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads, and let Spark drop the shuffle files of plans that are done."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._driftloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        spark._jvm.System.gc()  # executors keep shuffle files until the driver collects the plans


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most `rows` rows at a time in what is run inside; the session's setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
