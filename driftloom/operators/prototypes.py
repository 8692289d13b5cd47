"""Prototypes of classes chosen by likeness in a forest, and metrics of prototype sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct leaf combinations of a class whose choices one task makes, and that meet others in one task where a class has more.
BLOCK = 32_768
#: Candidates of a larger class that are measured again for each choice; all others are where these don't settle it.
HELD = 1_024
#: Choices of a class that are made ahead.
AHEAD = 64
#: Pairs of leaf combinations that are compared at once.
CELLS = 131_072


def fit_forest(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 0) -> RandomForestClassificationModel:
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    return RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, leafCol="_leaves").fit(data)


def with_leaves(model: RandomForestClassificationModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds `leaves`, the leaf of each tree that a row falls in, and `predicted`."""
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    out = model.transform(data).withColumn("leaves", F.transform(vector_to_array("_leaves"), lambda x: x.cast("int")))
    return out.select(*rows.columns, "leaves", F.col("prediction").cast("int").alias("predicted"))


def similarity(a: Column, b: Column) -> Column:
    """Share of trees in which two rows have the same leaf."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _matrix(leaves) -> np.ndarray:
    """Leaf combinations as rows, in as few bytes as hold them."""
    out = np.array(list(leaves), np.int64).reshape(len(leaves), -1) if len(leaves) else np.zeros((0, 1), np.int64)
    return out.astype(np.uint8) if out.size and 0 <= out.min() and out.max() < 256 else out


def _alike(candidates: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of trees in which each candidate and each row have the same leaf."""
    out = np.zeros((len(candidates), len(rows)), np.uint8 if rows.shape[1] < 256 else np.int32)
    for t in range(rows.shape[1]):
        np.add(out, (candidates[:, t, None] == np.ascontiguousarray(rows[:, t])).view(np.uint8), out=out)
    return out


def _pieces(candidates: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Parts of candidates and rows that are compared at once."""
    wide = min(len(rows), 4096) or 1
    for j in range(0, len(rows), wide):
        for i in range(0, len(candidates), CELLS // wide):
            yield slice(i, i + CELLS // wide), slice(j, j + wide)


def _best(chosen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The most trees that each row shares with what is chosen."""
    best = np.zeros(len(rows), np.uint8 if rows.shape[1] < 256 else np.int32)
    for one in chosen:
        np.maximum(best, _alike(one[None], rows)[0], out=best)
    return best


def _raises(candidates: np.ndarray, rows: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
    """By how many trees each candidate raises the sum of `best` over rows that stand for n rows each."""
    out, n = np.zeros(len(candidates), np.int64), n.astype(float)
    for some, part in _pieces(candidates, rows):
        alike = _alike(candidates[some], rows[part])
        np.maximum(alike, best[part], out=alike)
        alike -= best[part]
        out[some] += (alike.astype(float) @ n[part]).astype(np.int64)  # whole numbers
    return out


def _path(leaves: np.ndarray, n: np.ndarray, chosen: list[int], steps: int) -> list[tuple[int, int]]:
    """The next choices (gain in trees, place) of a class after those chosen; the first of equal ones wins.

    A gain never rises with what is chosen, so one that was found earlier bounds it: only candidates whose bound reaches the
    best gain are measured again, which leaves out none that could be chosen.
    """
    best, out = _best(leaves[chosen], leaves), []
    if chosen:
        bound = _raises(leaves, leaves, n, best)
    else:
        codes = [np.unique(leaves[:, t], return_inverse=True)[1] for t in range(leaves.shape[1])]
        bound = sum((np.bincount(c, n)[c].astype(np.int64) for c in codes), np.zeros(len(leaves), np.int64))
    bound[chosen] = -1
    fresh = np.ones(len(leaves), bool)
    for _ in range(steps):
        order, at, size = np.argsort(-bound, kind="stable"), 0, 32
        top = bound[fresh].max(initial=-1)
        while at < len(order) and bound[order[at]] >= max(top, 0):
            few = order[at : at + size]
            few = few[(bound[few] >= top) & ~fresh[few]]
            bound[few] = _raises(leaves[few], leaves, n, best)
            fresh[few] = True
            top, at, size = max(top, bound[few].max(initial=-1)), at + size, 2 * size
        pick = int(bound.argmax())
        out.append((int(bound[pick]), pick))
        np.maximum(best, _alike(leaves[pick][None], leaves)[0], out=best)
        bound[pick], fresh = -1, bound < 0
        fresh[pick] = True
    return out


class _Greedy:
    """Choices among all rows by gains over all rows.

    Rows are collapsed to distinct (label, leaves) with their number. A class of up to `block` of them makes its choices in one
    task, classes in parallel. Of a larger class the driver holds what is chosen and `held` candidates; every choice measures
    these over all rows, and where the best does not beat what bounds all others, blocks of all candidates meet blocks of all
    rows in tasks.
    """

    def __init__(self, leafed: DataFrame, held: int, block: int):
        distinct = leafed.where("label is not null").groupBy("label", "leaves").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
        self.rows, self.held, self.block = distinct.persist(), held, block
        sizes = self.rows.groupBy("label").agg(F.count("*").alias("_n"), F.sum("n").alias("_rows")).collect()
        self.sizes, self.different = {r.label: r._rows for r in sizes}, {r.label: r._n for r in sizes}
        self.classes = sorted(self.sizes)
        self.path: dict[object, list[tuple[float, int]]] = {c: [] for c in self.classes}  # gains and row ids
        self.leaves: dict[object, list[list[int]]] = {c: [] for c in self.classes}  # of what is chosen in larger classes
        self.near: dict[object, tuple[np.ndarray, np.ndarray, int]] = {}  # ids and leaves of held candidates, bound of all others

    def _blocks(self, n: int) -> int:
        return -(-n // self.block)

    def _ahead(self, classes: list, steps: int) -> None:
        """The next choices of classes that fit into a task."""
        chosen = {c: [i for _, i in self.path[c]] for c in classes}
        kind = self.rows.schema["label"].dataType.simpleString()

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id", ignore_index=True)
            ids, leaves = pdf["row_id"].to_numpy(), _matrix(pdf["leaves"])
            done = np.searchsorted(ids, chosen[key[0]]).tolist()
            found = _path(leaves, pdf["n"].to_numpy(), done, min(steps, len(ids) - len(done)))
            return pd.DataFrame({"label": [key[0]] * len(found), "at": range(len(found)), "gain": [g / leaves.shape[1] for g, _ in found], "row_id": ids[[i for _, i in found]]})

        schema = f"label {kind}, at int, gain double, row_id long"
        for r in sorted(self.rows.where(F.col("label").isin(classes)).groupBy("label").applyInPandas(run, schema).collect(), key=lambda r: r["at"]):
            self.path[r.label].append((round(r.gain, 6), r.row_id))

    def gains(self, classes: list) -> dict[object, np.ndarray]:
        """By how many trees each held candidate raises its class's sum, as one pass over the rows."""
        sent = self.rows.sparkSession.sparkContext.broadcast({c: (self.near[c][1], _matrix(self.leaves[c])) for c in classes})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros(len(sent.value[c][0]), np.int64) for c in classes]
            for pdf in batches:
                for k, c in enumerate(classes):
                    mine = pdf[pdf["label"] == c]
                    if len(mine):
                        rows = _matrix(mine["leaves"])
                        total[k] += _raises(sent.value[c][0], rows, mine["n"].to_numpy(), _best(sent.value[c][1], rows))
            yield pd.DataFrame({"class": np.repeat(np.arange(len(classes)), list(map(len, total))), "at": np.concatenate([np.arange(len(t)) for t in total]), "part": np.concatenate(total)})

        found = self.rows.where(F.col("label").isin(classes)).mapInPandas(run, "class int, at long, part long").groupBy("class", "at").agg(F.sum("part").alias("sum")).collect()
        out = {c: np.zeros(len(self.near[c][0]), np.int64) for c in classes}
        for r in found:
            out[classes[r["class"]]][r["at"]] = r["sum"]
        sent.unpersist()
        for c in classes:
            out[c][np.isin(self.near[c][0], [i for _, i in self.path[c]])] = -1
        return out

    def _meet(self, rows: DataFrame, blocks: int, part) -> DataFrame:
        """(row_id, part): part(candidates, their labels, rows, their labels, numbers) of all rows, summed for each candidate."""
        cut = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        mine = rows.select("label", "leaves", "row_id", cut.alias("x")).withColumn("y", every)
        theirs = rows.select(F.col("label").alias("label_b"), F.col("leaves").alias("leaves_b"), F.col("n").alias("n_b"), cut.alias("v")).withColumn("u", every)

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"row_id": a["row_id"], "part": np.zeros(len(a), np.int64)})
            return pd.DataFrame({"row_id": a["row_id"], "part": part(_matrix(a["leaves"]), a["label"].to_numpy(), _matrix(b["leaves_b"]), b["label_b"].to_numpy(), b["n_b"].to_numpy())})

        met = mine.groupBy("x", "y").cogroup(theirs.groupBy("u", "v")).applyInPandas(run, "row_id long, part long")
        return met.groupBy("row_id").agg(F.sum("part").alias("part"))

    def _all_gains(self, label) -> None:
        """Measures all candidates of a larger class, and holds the best of them."""
        chosen = _matrix(self.leaves[label])
        mine = self.rows.where(F.col("label") == F.lit(label))
        found = self._meet(mine, self._blocks(self.different[label]), lambda a, _a, b, _b, n: _raises(a, b, n, _best(chosen, b)))
        top = found.where(~F.col("row_id").isin([i for _, i in self.path[label]])).orderBy(F.desc("part"), "row_id").limit(self.held + 1)
        few = mine.join(F.broadcast(top), "row_id").select("row_id", "leaves", "part").toPandas().sort_values(["part", "row_id"], ascending=[False, True], ignore_index=True)
        bound = int(few["part"].iloc[-1]) if len(few) > self.held else -1
        few = few.iloc[: self.held]
        self.near[label] = few["row_id"].to_numpy(), _matrix(few["leaves"]), bound
        if len(few):
            self._take(label, int(few["part"].iloc[0]), 0)

    def _take(self, label, gain: int, at: int) -> None:
        ids, leaves, _ = self.near[label]
        self.path[label].append((round(gain / leaves.shape[1], 6), int(ids[at])))
        self.leaves[label].append(leaves[at].tolist())

    def _next(self, classes: list) -> None:
        """The next choice of larger classes."""
        known = [c for c in classes if c in self.near]
        for c, gain in (self.gains(known) if known else {}).items():
            ties = np.flatnonzero(gain == gain.max())
            at = ties[self.near[c][0][ties].argmin()]
            if gain[at] > self.near[c][2]:
                self._take(c, int(gain[at]), at)
                classes = [x for x in classes if x != c]
        for c in classes:
            self._all_gains(c)

    def sequence(self, label, depth: int, classes: list, steps: int = AHEAD) -> tuple[float, int]:
        """The best gain of a class after its first `depth` choices, and the row that has it. Choices of a class don't depend on
        other classes, so the next choices of all classes that are no further are made at once; they are kept."""
        while len(self.path[label]) <= depth:
            at = len(self.path[label])
            if at >= self.different[label]:
                return -1.0, -1
            ask = [c for c in classes if len(self.path[c]) <= at < self.different[c]]
            few = [c for c in ask if self.different[c] <= self.block]
            if few:
                self._ahead(few, max(min(steps, AHEAD), at))
            if label not in few:
                self._next([c for c in ask if c not in few])
        return self.path[label][depth]

    def medoids(self, k: int) -> dict[object, list[int]]:
        return {c: [self.sequence(c, i, self.classes, k)[1] for i in range(min(k, self.different[c]))] for c in self.classes}

    def over_classes(self, classes: list, n: int | None, weighted: bool, alpha: float | None = None) -> dict[object, list[int]]:
        """Each time a row of the class that gains most (by the share of its size if weighted).

        It stops at n rows; with alpha, where a gain falls within alpha of the one before; and where nothing gains.
        """
        chosen, last = {c: [] for c in classes}, None
        while classes and (n is None or sum(map(len, chosen.values())) < n):
            ahead = AHEAD if n is None else n
            value = lambda c: self.sequence(c, len(chosen[c]), classes, ahead)[0] / (self.sizes[c] if weighted else 1)  # noqa: E731, B023
            c = max(classes, key=value)
            top = value(c)
            if top <= 1e-6 / (self.sizes[c] if weighted else 1):
                break
            if alpha is not None and last is not None and abs(last - top) / top <= alpha and all(chosen.values()):
                break
            last = top
            chosen[c].append(self.sequence(c, len(chosen[c]), classes, ahead)[1])
        return chosen

    def accurate(self, n: int) -> list[tuple[int, object]]:
        """Rows (and classes) that raise the accuracy of the nearest prototype's label most, one after another, until none does."""
        chosen, leaves, now = [], [], -1
        blocks = self._blocks(sum(self.different.values()))
        while len(chosen) < n:
            taken, guesses = _matrix(leaves), np.array([c for _, c in chosen], object)

            def hits(a, mine, b, labels, n, taken=taken, guesses=guesses):
                out, n = np.zeros(len(a), np.int64), n.astype(float)
                for some, part in _pieces(a, b):
                    like = _alike(taken, b[part]).astype(int) if len(taken) else np.full((1, len(b[part])), -1)
                    right = guesses[like.argmax(0)] == labels[part] if len(taken) else np.zeros(like.shape[1], bool)
                    closer = _alike(a[some], b[part]) > like.max(0)
                    out[some] += (np.where(closer, mine[some, None] == labels[part], right) @ n[part]).astype(np.int64)
                return out

            best = self._meet(self.rows, blocks, hits).where(~F.col("row_id").isin([i for i, _ in chosen])).orderBy(F.desc("part"), "row_id").first() if blocks else None
            if best is None or best["part"] <= now:
                break
            now = best["part"]
            row = self.rows.where(F.col("row_id") == best["row_id"]).select("label", "leaves").first()
            chosen.append((best["row_id"], row["label"]))
            leaves.append(row["leaves"])
        return chosen


def select(leafed: DataFrame, method: str = "apete", k: int = 3, alpha: float = 0.01, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(row_id, class) of the prototypes of leafed rows (row_id, label, leaves), by one of kmedoids (k of each class), total
    and weighted (k in all), accuracy (k in all) and apete (as many as pay, then at least two of a class that has fewer).

    Every row with a label counts in the gains, and every distinct leaf combination of a class is a candidate, by its first row. `held` and
    `block` bound what the driver and a task hold (see _Greedy); they change no choice.
    """
    if method not in ("kmedoids", "total", "weighted", "accuracy", "apete"):
        raise ValueError(f"unknown selector {method}")
    greedy = _Greedy(leafed, held, block)
    classes = greedy.classes
    if method == "accuracy":
        rows = greedy.accurate(k)
    else:
        if method == "kmedoids":
            chosen = greedy.medoids(k)
        elif method == "apete":
            chosen = greedy.over_classes(classes, None, False, alpha)
            for c in classes:
                if len(chosen[c]) <= 2:
                    chosen[c] = greedy.over_classes([c], None, False, max(alpha, 0.05))[c]
        else:
            chosen = greedy.over_classes(classes, k, method == "weighted")
        rows = [(i, c) for c in classes for i in chosen[c]]
    greedy.rows.unpersist()
    return leafed.sparkSession.createDataFrame(rows, f"row_id long, class {leafed.schema['label'].dataType.simpleString()}")


def kmeans_prototypes(rows: DataFrame, features: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """(row_id, class): for each class the real rows nearest to the centres of k-means over all its rows, each row once."""
    kind, out = rows.schema["label"].dataType.simpleString(), []
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    for c in sorted(r.label for r in rows.select("label").distinct().collect()):  # a few classes
        mine = data.where(F.col("label").eqNullSafe(F.lit(c)))
        centers = KMeans(k=k, seed=seed, featuresCol="_x").fit(mine).clusterCenters()
        taken: list[int] = []
        for center in sorted(centers, key=tuple):
            away = sum((F.col(f) - float(v)) ** 2 for f, v in zip(features, center, strict=True))
            near = mine.where(~F.col("row_id").isin(taken)).orderBy(away, "row_id").select("row_id").first()
            taken += [near.row_id] if near else []
        out += [(i, c) for i in taken]
    return rows.sparkSession.createDataFrame(out, f"row_id long, class {kind}")


def assign(leafed: DataFrame, protos: DataFrame) -> DataFrame:
    """(row_id, label, predicted, proto_id, proto_class, similarity): the likest prototype of each row, ties to the lowest id;
    without any likeness proto_id and proto_class are -1. Prototypes (proto_id, class, leaves) are few."""
    listed = protos.agg(F.array_sort(F.collect_list(F.struct("proto_id", "class", F.col("leaves").alias("pl")))).alias("ps"))
    best = F.array_min(F.transform("ps", lambda p: F.struct((-similarity(F.col("leaves"), p["pl"])).alias("s"), p["proto_id"].alias("id"), p["class"].alias("class"))))
    rows = leafed.crossJoin(F.broadcast(listed)).withColumn("b", best)
    none = F.col("b.s") == 0
    return rows.select("row_id", "label", "predicted", F.when(none, -1).otherwise(F.col("b.id")).alias("proto_id"), F.when(none, -1).otherwise(F.col("b.class")).alias("proto_class"), (-F.col("b.s")).alias("similarity"))


def prototype_metrics(assigned: DataFrame) -> DataFrame:
    """For each prototype: rows it is likest to, its share of all (voting frequency), of them the share with its class
    (consistent votes), and the mean likeness of rows of its own and of other classes."""
    n = Window.partitionBy()
    own = F.col("label") == F.col("proto_class")
    per = assigned.groupBy("proto_id", "proto_class").agg(
        F.count("*").alias("hubness"), F.avg(own.cast("double")).alias("consistent_votes"),
        F.avg(F.when(own, F.col("similarity"))).alias("in_distribution"), F.avg(F.when(~own, F.col("similarity"))).alias("out_distribution"),
    )
    return per.withColumn("voting_frequency", F.col("hubness") / F.sum("hubness").over(n))  # a row for each prototype


def group_metrics(assigned: DataFrame) -> DataFrame:
    """Accuracy and fidelity (agreement with the forest) of the prototypes, mean likeness within and outside the class, and the
    entropy of the share of each prototype, as a part of its largest possible value."""
    own = F.col("label") == F.col("proto_class")
    share = prototype_metrics(assigned).agg((-F.sum(F.col("voting_frequency") * F.log2("voting_frequency")) / F.greatest(F.log2(F.count("*").cast("double")), F.lit(1e-12))).alias("hubness_entropy"))
    rows = assigned.agg(
        F.avg(own.cast("double")).alias("accuracy"), F.avg((F.col("predicted") == F.col("proto_class")).cast("double")).alias("fidelity"),
        F.avg(F.when(own, F.col("similarity"))).alias("mean_in"), F.avg(F.when(~own, F.col("similarity"))).alias("mean_out"),
    )
    return rows.crossJoin(share)  # one row each


def reassignment_impact(leafed: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean change of accuracy when single prototypes of one set join the other, averaged over both directions."""

    def one_way(base: DataFrame, extra: DataFrame) -> DataFrame:
        now = assign(leafed, base).select("row_id", "label", "similarity", (F.col("label") == F.col("proto_class")).alias("hit"))
        few = extra.select(F.col("proto_id").alias("extra_id"), F.col("class").alias("extra_class"), F.col("leaves").alias("extra_leaves"))
        rows = now.join(leafed.select("row_id", "leaves"), "row_id").crossJoin(F.broadcast(few))  # a bounded number of prototypes
        closer = similarity(F.col("leaves"), F.col("extra_leaves")) > F.col("similarity")
        hit = F.when(closer, F.col("extra_class") == F.col("label")).otherwise(F.col("hit"))
        return rows.groupBy("extra_id").agg(F.abs(F.avg(hit.cast("double")) - F.avg(F.col("hit").cast("double"))).alias("change")).agg(F.avg("change").alias("impact"))

    return one_way(a, b).unionAll(one_way(b, a)).agg(F.avg("impact").alias("impact"))


def best_two(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """(row_id, label, predicted, one, two): the likest prototype of each row and the likest of the others, as structs of likeness,
    proto_id and class; ties go to the lowest id, and two is null where there is one prototype only. Prototypes are few."""
    listed = protos.agg(F.array_sort(F.collect_list(F.struct("proto_id", "class", F.col("leaves").alias("pl")))).alias("ps"))
    ranked = F.array_sort(F.transform("ps", lambda p: F.struct((-similarity(F.col("leaves"), p["pl"])).alias("away"), p["proto_id"].alias("proto_id"), p["class"].alias("class"))))
    return rows.crossJoin(F.broadcast(listed)).withColumn("_r", ranked).select("row_id", "label", "predicted", F.get("_r", F.lit(0)).alias("one"), F.get("_r", F.lit(1)).alias("two"))


def contributions(rows: DataFrame, protos: DataFrame, against: str = "predicted") -> DataFrame:
    """(proto_id, class, contribution): by how much the balanced accuracy of the prototypes falls when one of them is left out.

    The balanced accuracy is the mean over the classes of `against` (the forest's `predicted` or the `label`) of the share of
    rows whose likest prototype has the class. Without its likest prototype a row falls to the second, so one pass over rows
    and their best two gives the accuracy without each prototype; only sums by class and prototype are joined. Prototypes
    that no row is likest to contribute 0; without any other prototype all of the accuracy is lost. Rows without a class
    don't count.
    """
    near = best_two(rows, protos).where(F.col(against).isNotNull())
    own, other = F.col("one.class").eqNullSafe(F.col(against)), F.coalesce(F.col("two.class") == F.col(against), F.lit(False))
    cells = near.groupBy(F.col(against).alias("_class"), F.col("one.proto_id").alias("proto_id")).agg(
        F.count("*").alias("_rows"), (F.sum(own.cast("int")) - F.sum(other.cast("int"))).alias("_lost")
    )
    sizes = near.groupBy(F.col(against).alias("_class")).agg(F.count("*").alias("_size"))  # a row for each class
    classes = sizes.agg(F.count("*").alias("_classes"))
    falls = cells.join(F.broadcast(sizes), "_class").groupBy("proto_id").agg(F.sum(F.col("_lost") / F.col("_size")).alias("_fall"))
    out = protos.select("proto_id", "class").join(falls, "proto_id", "left").crossJoin(F.broadcast(classes))
    return out.select("proto_id", "class", F.coalesce(F.col("_fall") / F.col("_classes"), F.lit(0.0)).alias("contribution"))


def mean_contribution(rows: DataFrame, protos: DataFrame, against: str = "predicted") -> DataFrame:
    """The mean contribution of a set of prototypes."""
    return contributions(rows, protos, against).agg(F.avg("contribution").alias("contribution"))
