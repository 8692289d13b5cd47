"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of driftloom.llm and works on all that the stage before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import decontamination, language_id, ngram_join, packing, secrets
from driftloom.llm.queries import tokenizer_path
from driftloom.llm.storage import batch_rows, materialize

#: Texts that Python workers get at a time.
TEXT_ROWS = 1000

#: No SQL expresses a trained network or a vocabulary's merges; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter and those whose best language is scarcely likelier than chance."""
    return language_id.keep_spoken(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a 10-word window of a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in place; no document goes."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), 4096, 1)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with batch_rows(spark, TEXT_ROWS):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
