"""Groups of equal texts, by merging sorted runs of digests in rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, materialize, release

#: Bits of the run number that one round merges away: 2**ROUND_BITS runs meet in each.
ROUND_BITS = 5

#: White space that does not count: ASCII 0x20 and 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"

_KEY = ["digest", "length", "check"]


def normalised(text: Column) -> Column:
    """A text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def merged_runs(runs: DataFrame, n_runs: int, bits: int = ROUND_BITS) -> DataFrame:
    """(digest, length, check, best, size) over all runs, from one row for each run and text.

    In each round 2**bits neighbouring runs exchange what they hold of a text and merge it into one run: sizes add up, the
    smallest `best` stays. So no task ever meets more than 2**bits rows of one text, however many copies it has.
    """
    while n_runs > 1:
        runs = runs.withColumn("run", F.shiftright("run", bits)).groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        n_runs = -(-n_runs >> bits)
    return runs.drop("run")


def mark_copies(docs: DataFrame, column: str, columns: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = ROUND_BITS) -> DataFrame:
    """`columns` of docs (all, if not given) with a struct `column`: keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Each group keeps the row with the most code points in its
    original text, then the smallest id (null last); of rows alike in all this, one. Rows are written once, with their run
    (the partition that read them) and a row number, in order of their digests. A text is one row of a run before anything
    is shuffled. Equal SHA-256 digests are verified by the length and a second hash of the normalised texts at every level;
    texts that differ in these are never merged. Groups find their rows again run by run, so copies of one text are spread
    over as many tasks as runs hold them.
    A null text counts as empty. Long texts are hashed whole. An empty table gives no rows. The written rows stay in the
    shared folder, since the result reads them.
    """
    names = list(docs.columns if columns is None else columns)
    inner = free_name(docs, "_copy")
    text = normalised(F.col(text_col))
    mine = F.struct(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.char_length(text).alias("length"), F.xxhash64(text).alias("check"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), F.col(id_col).alias("id"),
    )
    rows = materialize(docs.select(*names, mine.alias(inner)).sortWithinPartitions(f"{inner}.digest"), "digest-runs")

    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "row")
    runs = rows.select(f"{inner}.*").groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("size"))
    runs = materialize(runs, "text-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    groups = merged_runs(runs, n_runs, bits).where("size > 1")
    group = free_name(docs, "_group")
    groups = runs.select("run", *_KEY).join(groups, _KEY).select(F.struct(F.struct("run", *_KEY).alias("at"), "best", "size").alias(group))
    groups = materialize(groups, "copy-groups")
    release(runs)

    own, found = F.col(inner), F.col(group)
    alone = found.isNull()
    marked = rows.join(groups, F.struct(*[own[k].alias(k) for k in ("run", *_KEY)]) == found["at"], "left")
    mark = F.struct(
        F.when(alone, own["id"]).otherwise(found["best"]["id"]).alias("keep_id"), F.coalesce(found["size"], F.lit(1)).cast("long").alias("group_size"),
        (alone | (found["best"]["row"] == own["row"])).alias("kept"), F.lower(F.hex(own["digest"])).alias("text_sha256"),
    )
    return marked.select(*names, mark.alias(column))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts (see mark_copies). All columns stay."""
    name = free_name(docs, "_copies")
    return mark_copies(docs, name, None, id_col, text_col).where(F.col(name)["kept"]).select(*docs.columns)
