"""A plane learnt by a network with two heads: one tells the class of a point of the plane, the other its features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rows that the network is trained on, a bounded sample by a hash; widths of the layers on the way to the plane.
SAMPLE, WIDTHS = 10_000, (512, 128, 32)

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Network:
    """Layers to the plane (the last has two units) and back, and the two heads. All arrays are (weights, biases)."""

    encoder: Layers
    decoder: Layers
    classes: tuple[np.ndarray, np.ndarray]
    features: tuple[np.ndarray, np.ndarray]

    @classmethod
    def random(cls, d: int, n_classes: int, widths: Sequence[int], rng: np.random.Generator) -> Network:
        layer = lambda a, b: (rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b))
        down = [d, *widths, 2]
        up = [2, *reversed(widths)]
        chain = lambda sizes: [layer(a, b) for a, b in zip(sizes, sizes[1:], strict=False)]
        return cls(chain(down), chain(up), layer(up[-1], n_classes), layer(up[-1], d))

    def parameters(self) -> list[np.ndarray]:
        return [a for pair in (*self.encoder, *self.decoder, self.classes, self.features) for a in pair]

    def encode(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.encoder):
            x = x @ w + b
            x = np.tanh(x) if i == len(self.encoder) - 1 else np.maximum(x, 0)
        return x

    def _trunk(self, z: np.ndarray) -> np.ndarray:
        for w, b in self.decoder:
            z = np.maximum(z @ w + b, 0)
        return z

    def decode(self, z: np.ndarray) -> np.ndarray:
        w, b = self.features
        return 1 / (1 + np.exp(-np.clip(self._trunk(z) @ w + b, -500, 500)))

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        w, b = self.classes
        s = self._trunk(z) @ w + b
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of the classes plus that of the features (each within 0 and 1), and its slope along every parameter."""
        n, d = x.shape
        layers = [*self.encoder, *self.decoder]
        middle, kept, a = len(self.encoder) - 1, [x], x
        for i, (w, b) in enumerate(layers):
            a = np.tanh(a @ w + b) if i == middle else np.maximum(a @ w + b, 0)
            kept.append(a)
        (wc, bc), (wf, bf) = self.classes, self.features
        s = a @ wc + bc
        s -= s.max(1, keepdims=True)
        log_p = s - np.log(np.exp(s).sum(1, keepdims=True))
        r = np.clip(a @ wf + bf, -500, 500)
        loss = -log_p[np.arange(n), y].mean() + (np.logaddexp(0, r) - x * r).mean()
        dc = np.exp(log_p)
        dc[np.arange(n), y] -= 1
        dc /= n
        df = (1 / (1 + np.exp(-r)) - x) / (n * d)
        heads = [a.T @ dc, dc.sum(0), a.T @ df, df.sum(0)]
        da, out = dc @ wc.T + df @ wf.T, []
        for i in range(len(layers) - 1, -1, -1):
            a = kept[i + 1]
            dz = da * (1 - a * a) if i == middle else da * (a > 0)
            out = [kept[i].T @ dz, dz.sum(0), *out]
            da = dz @ layers[i][0].T
        return float(loss), [*out, *heads]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float, rng: np.random.Generator) -> list[float]:
        """Mean loss of each epoch of shuffled batches, with steps scaled by running moments of the slopes (Adam)."""
        at = self.parameters()
        first, second, step, losses = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at], 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), batch):
                few = order[i : i + batch]
                loss, slopes = self.loss_and_gradients(x[few], y[few])
                total += loss * len(few)
                step += 1
                for p, g, m, v in zip(at, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(x))
        return losses


@dataclass
class NeuralPlane:
    """A trained network with the range of each feature. It stands in for the plane of principal axes in boundary maps."""

    features: list[str]
    low: np.ndarray
    high: np.ndarray
    labels: list
    network: Network
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str = "label", widths: Sequence[int] = WIDTHS, epochs: int = 30, batch: int = 64, rate: float = 1e-3, sample: int = SAMPLE, seed: int = 0) -> NeuralPlane:
        """Ranges and labels are those of all rows, weights are learnt from `sample` of them. Rows with a null don't count."""
        whole = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).alias("_label")).dropna()
        ends = whole.agg(*[F.struct(F.min(f), F.max(f)) for f in features], F.array_sort(F.collect_set("_label"))).first()
        labels = ends[-1]
        if not labels:
            raise ValueError("no rows to learn from")
        low, high = (np.array([e[i] for e in ends[:-1]], float) for i in (0, 1))
        few = whole.orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(sample).toPandas()
        rng = np.random.default_rng(seed)
        network = Network.random(len(features), len(labels), widths, rng)
        made = cls(list(features), low, high, labels, network)
        place = {v: i for i, v in enumerate(labels)}
        made.losses = network.train(made._scaled(few[features].to_numpy(float)), few["_label"].map(place).to_numpy(int), epochs, batch, rate, rng)
        return made

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / np.where(self.high > self.low, self.high - self.low, 1)

    def _apply(self, rows: DataFrame, columns: list[str], names: list[str], kind: str, run) -> DataFrame:
        @pandas_udf("array<double>")
        def carried(points: pd.Series) -> pd.Series:
            out = np.full(len(points), None, object)
            whole = np.array([p is not None and all(v is not None and v == v for v in p) for p in points], bool)
            if whole.any():
                out[np.flatnonzero(whole)] = list(run(np.array([list(p) for p in points[whole]], float)))
            return pd.Series(out)

        made = rows.withColumn("_made", carried(F.array(*[F.col(c).cast("double") for c in columns])))
        return made.withColumns({n: F.get("_made", F.lit(i)).cast(kind) for i, n in enumerate(names)}).drop("_made")

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds u and v, each between -1 and 1; null where a feature is."""
        return self._apply(rows, self.features, ["u", "v"], "double", lambda x: self.network.encode(self._scaled(x)))

    def inverse(self, rows: DataFrame) -> DataFrame:
        """Adds the features of points (u, v), within the ranges of the rows that it was fitted on."""
        return self._apply(rows, ["u", "v"], self.features, "double", lambda z: self.low + self.network.decode(z) * (self.high - self.low))

    def classify(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """Adds the place of the likeliest label (in order) of points (u, v), and its probability as <name>_p."""
        return self._apply(rows, ["u", "v"], [name, f"{name}_p"], "double", lambda z: (lambda p: np.column_stack([p.argmax(1), p.max(1)]))(self.network.probabilities(z)))
