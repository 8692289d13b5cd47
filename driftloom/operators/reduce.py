"""Projections from sums over all rows: principal, discriminant and independent axes, factors, and scaling by landmarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.sources.scratch import materialize, release

from .recurrence import l2


@dataclass
class Projection:
    """Rows minus mean, times axes; fitted on one block it is applied to others unchanged."""

    features: list[str]
    mean: np.ndarray
    axes: np.ndarray

    def transform(self, rows: DataFrame, prefix: str = "z") -> DataFrame:
        line = lambda a: sum((F.lit(float(w)) * (F.col(f) - float(m)) for w, f, m in zip(a, self.features, self.mean, strict=True)), F.lit(0.0))
        return rows.withColumns({f"{prefix}{i + 1}": line(a) for i, a in enumerate(self.axes)})


def _moments(rows: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count of rows, means, and covariances of the population; of two features over the rows that have both.

    Tasks send d x d sums of products around the means, made batch by batch in matrix products; the driver gets them summed.
    """
    d = len(features)
    held = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    n, *mean = held.agg(F.count("*"), *[F.avg(f) for f in features]).first()
    mean = np.array(mean, float)
    centre = np.nan_to_num(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums, products = np.zeros((3, d, d))
        for batch in batches:
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.where(there > 0, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - centre, 0.0)
            both += there.T @ there
            sums += x.T @ there
            products += x.T @ x
        i, j = np.indices((d, d)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, both, sums, products)], ["i", "j", "n", "s", "p"])

    n_both, sums, products = np.zeros((3, d, d))
    for r in held.mapInArrow(run, "i int, j int, n double, s double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nsp"]).collect():
        n_both[r.i, r.j], sums[r.i, r.j], products[r.i, r.j] = r.n, r.s, r.p
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, mean, products / n_both - sums * sums.T / n_both**2


def _signed(axes: np.ndarray) -> np.ndarray:
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def pca(rows: DataFrame, features: list[str], k: int = 2) -> Projection:
    """The k directions of most variance; on Euclidean distances classical scaling gives the same coordinates."""
    _, mean, cov = _moments(rows, features)
    _, vectors = np.linalg.eigh(cov)
    return Projection(features, mean, _signed(vectors[:, ::-1][:, :k].T))


def lda(rows: DataFrame, features: list[str], k: int = 1, label: str = "label") -> Projection:
    """The k directions, fewer than classes, that separate class means most in units of the spread within classes."""
    classes = rows.groupBy(label).agg(F.count("*"), *[F.avg(f) for f in features]).collect()
    if k >= len(classes):
        raise ValueError(f"{len(classes)} classes allow fewer than {len(classes)} directions")
    n, mean, total = _moments(rows, features)
    between = np.zeros_like(total)
    for r in classes:
        gap = np.array(r[2:], float) - mean
        between += r[1] / n * np.outer(gap, gap)
    values, vectors = np.linalg.eig(np.linalg.pinv(total - between) @ between)
    axes = np.real(vectors[:, np.argsort(-np.real(values))[:k]]).T
    return Projection(features, mean, _signed(axes / np.linalg.norm(axes, axis=1, keepdims=True)))


def _whitening(cov: np.ndarray, k: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov)
    top = values[::-1][:k]
    if top[-1] <= 1e-12 * max(top[0], 1e-300):
        raise ValueError(f"the features have fewer than {k} independent directions")
    return vectors[:, ::-1][:, :k].T / np.sqrt(top)[:, None]


def ica(rows: DataFrame, features: list[str], k: int = 2, steps: int = 100, tolerance: float = 1e-6, seed: int = 0) -> Projection:
    """The k directions along which rows are least normal, as far apart as sources that were mixed; scores have variance 1.

    Rows are whitened by their moments. Each step of the symmetric fixed point (with tanh) is one pass over all rows, whose
    tasks send k x (k + 1) sums. Directions are ordered by how far from normal their scores are. Rows with nulls don't count.
    """
    held = materialize(rows.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna(), "whitened")
    n, mean, cov = _moments(held, features)
    white = _whitening(cov, k)
    sc = rows.sparkSession.sparkContext

    def sums(w: np.ndarray, moment: int) -> np.ndarray:
        sent = sc.broadcast((w @ white, white))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            axes, base = sent.value
            total = np.zeros((len(axes), len(base) + 1))
            for pdf in batches:
                x = pdf.to_numpy(float) - mean
                y = x @ axes.T
                g = np.tanh(y)
                total[:, :-1] += g.T @ (x @ base.T)
                total[:, -1] += (1 - g * g).sum(0) if moment == 1 else np.log(np.cosh(y)).sum(0)
            yield pd.DataFrame([(i, j, v) for (i, j), v in np.ndenumerate(total)], columns=["i", "j", "v"])

        out = np.zeros((len(w), len(white) + 1))
        for r in held.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r.i, r.j] = r.v / n
        sent.unpersist()
        return out

    def apart(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = apart(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(steps):
        e = sums(w, 1)
        new = apart(e[:, :-1] - e[:, -1][:, None] * w)
        moved, w = np.abs(np.abs((new * w).sum(1)) - 1).max(), new
        if moved < tolerance:
            break
    normal = 0.3745672075  # mean of log cosh over a standard normal
    order = np.argsort(-np.abs(sums(w, 0)[:, -1] - normal))
    release(held)
    return Projection(features, mean, _signed((w @ white)[order]))


@dataclass
class Factors:
    """A few hidden factors and the loadings by which they make the features, each with a noise of its own."""

    loadings: np.ndarray
    noise: np.ndarray
    scores: Projection


def factor_analysis(rows: DataFrame, features: list[str], k: int = 2, steps: int = 1000, tolerance: float = 1e-8) -> Factors:
    """Factors by expectation and maximisation on the features' covariance, which one pass over all rows sums up.

    Scores are the factors' expected values given the features. Loadings are turned to their principal axes.
    """
    _, mean, s = _moments(rows, features)
    values, vectors = np.linalg.eigh(s)
    loadings = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-12))
    noise = np.maximum(np.diag(s) - (loadings**2).sum(1), 1e-3 * np.diag(s))
    last = -np.inf
    for _ in range(steps):
        inverse = np.linalg.inv(loadings @ loadings.T + np.diag(noise))
        beta = loadings.T @ inverse
        second = np.eye(k) - beta @ loadings + beta @ s @ beta.T
        loadings = s @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(s - loadings @ beta @ s), 1e-9)
        sign, log_det = np.linalg.slogdet(loadings @ loadings.T + np.diag(noise))
        fit = -(log_det + np.trace(np.linalg.solve(loadings @ loadings.T + np.diag(noise), s)))
        if fit - last < tolerance:
            break
        last = fit
    _, _, turn = np.linalg.svd(loadings / np.sqrt(noise)[:, None], full_matrices=False)
    loadings = _signed((loadings @ turn.T).T).T
    beta = loadings.T @ np.linalg.inv(loadings @ loadings.T + np.diag(noise))
    return Factors(loadings, noise, Projection(features, mean, beta))


@dataclass
class Landmarks:
    """Coordinates of any row from its distances to landmarks whose own coordinates are known."""

    points: np.ndarray
    axes: np.ndarray
    mean: np.ndarray
    distance: Callable[[Column, Column], Column]

    def transform(self, rows: DataFrame, prefix: str = "z", vector: str = "x") -> DataFrame:
        """Adds the coordinates of each row by its array column `vector`. The landmarks go along with the plan."""
        spread = F.array(*[F.array(*map(F.lit, map(float, p))) for p in self.points])
        far = F.transform(spread, lambda p: F.pow(self.distance(F.col(vector), p), F.lit(2)))
        line = lambda a: F.aggregate(F.zip_with("_far", F.array(*[F.lit(float(w)) for w in a]), lambda d, w: d * w), F.lit(float(self.mean @ a)), lambda s, v: s - v)
        placed = rows.withColumn("_far", far)
        return placed.withColumns({f"{prefix}{i + 1}": line(a) for i, a in enumerate(self.axes)}).drop("_far")


def landmark_scaling(rows: DataFrame, k: int = 2, landmarks: int = 100, distance: Callable[[Column, Column], Column] = l2, vector: str = "x", seed: int = 0) -> Landmarks:
    """Classical scaling of `landmarks` rows, from which all others are placed by their distances to these.

    Landmarks are the rows first in a hash's order, a documented bound; their distances (landmarks squared) are doubly
    centred on the driver. Distances may be any function of two array columns; for plain ones the places of all rows have
    the same distances as rows in the k directions of most spread.
    """
    few = rows.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x")).distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(landmarks)
    points = [list(map(float, r.x)) for r in few.collect()]
    if len(points) <= k:
        raise ValueError(f"{len(points)} different landmarks for {k} directions")
    listed = rows.sparkSession.createDataFrame(list(enumerate(points)), "at int, x array<double>")
    pairs = listed.crossJoin(F.broadcast(listed.select(F.col("at").alias("to"), F.col("x").alias("y"))))  # landmarks squared
    d2 = np.zeros((len(points), len(points)))
    for r in pairs.select("at", "to", distance(F.col("x"), F.col("y")).alias("d")).collect():
        d2[r.at, r.to] = r.d**2
    mean = d2.mean(0)
    centred = -0.5 * (d2 - mean[None] - d2.mean(1)[:, None] + d2.mean())
    values, vectors = np.linalg.eigh(centred)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    if values[-1] <= 1e-9 * max(values[0], 1e-300):
        raise ValueError(f"the landmarks span fewer than {k} directions")
    return Landmarks(np.array(points), _signed(0.5 * (vectors / np.sqrt(values)).T), mean, distance)
