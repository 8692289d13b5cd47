"""Connected components of a table of links, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node it can reach.

    Alternates two steps until nothing changes: every node tells its larger neighbours, then its smaller ones, of the
    smallest node it sees. All links of a component end as a star around that node, after a logarithmic number of rounds. Minima are
    summed up per task first and links are joined, so a node with many links does not gather them.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    seen = _signature(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialize(large, "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # links point down, so this is the smallest neighbour
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.*").where("a > b").distinct(), "links")
        release(now, large)
        signature, now = _signature(after), after
        if signature == seen:
            break
        seen = signature
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    found = materialize(stars, "components")
    release(now)
    return found
