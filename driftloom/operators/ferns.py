"""A forest that learns along a stream without order inside it: fixed random splits, class counts at leaves added up by window."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ferns:
    """Trees whose levels split all nodes alike: splits[t][l] is the (feature, cut) of level l of tree t.

    What a tree has learnt are counts at its leaves. Counts of any two parts of a stream add up, so all windows learn at once.
    """

    splits: tuple[tuple[tuple[str, float], ...], ...]

    @classmethod
    def random(cls, ranges: Mapping[str, tuple[float, float]], trees: int = 20, depth: int = 4, seed: int = 0, digits: int = 4) -> Ferns:
        """Random features, and cuts drawn evenly from each feature's (low, high)."""
        rng = np.random.default_rng(seed)
        names = list(ranges)
        draw = lambda f: (f, round(float(rng.uniform(*ranges[f])), digits))
        return cls(tuple(tuple(draw(names[rng.integers(len(names))]) for _ in range(depth)) for _ in range(trees)))

    def leaves(self) -> Column:
        """The leaf of each tree as an array; a null feature counts as below every cut."""
        above = lambda f, cut, level: F.coalesce(F.col(f) > cut, F.lit(False)).cast("int") * (1 << level)
        return F.array(*[sum((above(f, cut, level) for level, (f, cut) in enumerate(tree)), F.lit(0)) for tree in self.splits])


def leaf_counts(rows: DataFrame) -> DataFrame:
    """(win, tree, leaf, label, n): rows of a label in a leaf up to the end of each window in which the leaf gets rows, for rows
    (win, label, leaves). A label that the leaf has had before is listed with its count, though it gets none in this window."""
    hits = rows.select("win", "label", F.posexplode("leaves").alias("tree", "leaf")).groupBy("win", "tree", "leaf", "label").agg(F.count("*").alias("_n"))
    wins = hits.select("win", "tree", "leaf").distinct()
    first = hits.groupBy("tree", "leaf", "label").agg(F.min("win").alias("_first"))
    cells = wins.join(first, ["tree", "leaf"]).where("win >= _first")  # one row for each window, leaf and label at most
    filled = cells.join(hits, ["win", "tree", "leaf", "label"], "left")
    upto = Window.partitionBy("tree", "leaf", "label").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("win", "tree", "leaf", "label", F.sum(F.coalesce("_n", F.lit(0))).over(upto).alias("n"))


def tree_weights(counts: DataFrame) -> DataFrame:
    """(win, tree, weight): accuracy of each tree up to the end of each window, on all rows up to there: the share of its rows
    with the most frequent label of their leaf, for leaf_counts."""
    at = counts.groupBy("win", "tree", "leaf").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    before = Window.partitionBy("tree", "leaf").orderBy("win")
    gained = lambda c: F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))
    steps = at.select("win", "tree", gained("top").alias("top"), gained("all").alias("all")).groupBy("win", "tree").agg(F.sum("top").alias("top"), F.sum("all").alias("all"))
    upto = Window.partitionBy("tree").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)  # a row for each window
    return steps.select("win", "tree", (F.sum("top").over(upto) / F.sum("all").over(upto)).alias("weight"))
