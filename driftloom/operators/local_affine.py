"""A plane in which every row lies by an orthogonal fit of its own to control points, and the way back."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Most control points; rows of the sample that they are chosen from, for each; numbers that a batch of fits may hold.
MAX_CONTROLS, SAMPLE_EACH, BATCH_NUMBERS = 300, 20, 4_000_000


def classical_places(x: np.ndarray) -> np.ndarray:
    """Two coordinates of rows whose distances are near those of x, along its directions of most spread."""
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    out = np.zeros((len(x), 2))
    k = min(2, len(s))
    out[:, :k] = u[:, :k] * s[:k]
    return out


def stress(x: np.ndarray, y: np.ndarray) -> float:
    """Squared differences of distances as a share of the squared distances of x."""
    far = lambda a: np.sqrt(np.maximum(((a[:, None] - a[None]) ** 2).sum(2), 0))
    dx = far(x)
    return float(((dx - far(y)) ** 2).sum() / max((dx**2).sum(), 1e-300))


def force_places(x: np.ndarray, steps: int = 50, fraction: float = 10.0) -> np.ndarray:
    """classical_places, then every point pushes and pulls every other one by a fraction of what their distance is off.

    A step that raises the stress is undone and the fraction made smaller.
    """
    dx = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    y = classical_places(x)
    least = stress(x, y)
    for _ in range(steps):
        apart = y[None] - y[:, None]
        dy = np.sqrt((apart**2).sum(2))
        pull = np.where(dy > 0, (dx - dy) / np.where(dy > 0, dy, 1), 0) / fraction
        moved = y + (apart * pull[:, :, None]).sum(0) / len(y)
        now = stress(x, moved)
        if now < least:
            y, least = moved, now
        else:
            fraction *= 2
    return y


def affine(points: np.ndarray, source: np.ndarray, target: np.ndarray, near: int | None = None) -> np.ndarray:
    """Places of points that lie among `source` as they would lie among `target`.

    For each point controls are weighted by one over the squared distance (only the `near` closest, if given); their weighted
    means are the origins on both sides, and between them the orthogonal map that fits the weighted controls best
    (from a small singular value decomposition) carries the point over. A point at a control goes where it went.
    """
    out = np.empty((len(points), target.shape[1]))
    batch = max(1, BATCH_NUMBERS // max(1, len(source) * (source.shape[1] + target.shape[1])))
    unit = max(float(((source - source.mean(0)) ** 2).sum(1).mean()), 1e-300)
    for at in range(0, len(points), batch):
        p = points[at : at + batch]
        d2 = ((p[:, None] - source[None]) ** 2).sum(2)
        closest = d2.argmin(1)
        same = d2[np.arange(len(p)), closest] < 1e-12 * unit
        alpha = 1 / np.maximum(d2, 1e-12 * unit)
        if near is not None and near < len(source):
            edge = np.partition(d2, near - 1, axis=1)[:, near - 1]
            alpha[d2 > edge[:, None]] = 0
        alpha /= alpha.sum(1, keepdims=True)
        from_, to = alpha @ source, alpha @ target
        cross = np.matmul((alpha[:, :, None] * (source[None] - from_[:, None])).transpose(0, 2, 1), target[None] - to[:, None])
        u, _, v = np.linalg.svd(cross, full_matrices=False)
        placed = np.matmul((p - from_)[:, None], np.matmul(u, v))[:, 0] + to
        out[at : at + batch] = np.where(same[:, None], target[closest], placed)
    return out


@dataclass
class LocalAffine:
    """Control points and their places in the plane. It stands in for the plane of principal axes in boundary maps.

    transform adds u and v to rows with the features, inverse the features to points (u, v), which are carried back by the
    `near` controls closest in the plane. Both are batches of small fits in any number of tasks; rows with a null get nulls.
    """

    features: list[str]
    controls: np.ndarray
    places: np.ndarray
    near: int = 12

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], controls: int | None = None, near: int = 12, seed: int = 0) -> LocalAffine:
        """About the square root of the number of rows as controls, MAX_CONTROLS at most: rows of a bounded sample (by a hash), each
        the farthest from those before it. Their places come from force_places."""
        whole = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
        k = controls or max(4, min(MAX_CONTROLS, math.isqrt(whole.count())))
        few = whole.distinct().orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(SAMPLE_EACH * k)
        x = few.toPandas().to_numpy(float)
        if len(x) < 2:
            raise ValueError("fewer than two different rows")
        chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        away = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(k, len(x)):
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
        return cls(list(features), x[chosen], force_places(x[chosen]), near)

    def _apply(self, rows: DataFrame, columns: list[str], names: list[str], source: np.ndarray, target: np.ndarray, near: int | None) -> DataFrame:
        @pandas_udf("array<double>")
        def carried(points: pd.Series) -> pd.Series:
            out = np.full(len(points), None, object)
            whole = np.array([p is not None and all(v is not None and v == v for v in p) for p in points], bool)
            if whole.any():
                placed = affine(np.array([list(p) for p in points[whole]], float), source, target, near)
                out[np.flatnonzero(whole)] = list(placed)
            return pd.Series(out)

        point = F.array(*[F.col(c).cast("double") for c in columns])
        made = rows.withColumn("_placed", carried(point))
        return made.withColumns({n: F.get("_placed", F.lit(i)) for i, n in enumerate(names)}).drop("_placed")

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds u and v."""
        return self._apply(rows, self.features, ["u", "v"], self.controls, self.places, None)

    def inverse(self, rows: DataFrame) -> DataFrame:
        """Adds the features of points (u, v)."""
        return self._apply(rows, ["u", "v"], self.features, self.places, self.controls, self.near)
