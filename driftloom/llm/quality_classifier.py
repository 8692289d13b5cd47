"""Quality scores from trusted positives and unlabelled text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Most positives, and most unlabelled documents, that training takes.
SAMPLE = 15_000
SYMBOLS = b"#*$%&|<>"
MARKS = (b"!", b"?", b".", b",", b"|", b"#", b"&", b"*", b"$", b"%", b"/", b"@", b":", b"\"")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))


def features_of(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for a null or empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda drop: 1 - len(raw.translate(None, drop)) / size if raw else 0.0
    upper, lower = without(_UPPER), without(_LOWER)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, len(counts) / n if words else 0.0,
        max(counts.values(), default=0) / n, pairs / max(n - 1, 1), upper, lower, upper / (upper + lower + 1e-3), without(_DIGITS),
        np.sqrt(without(SYMBOLS)), len(lines) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(1 for w in counts if len(w) <= 3) / max(len(counts), 1), sum(k for w, k in counts.items() if len(w) <= 3) / n,
        *(np.sqrt(raw.count(m) / n) for m in MARKS),
    ]


@dataclass
class Scorer:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(self.standard(x) @ a + b, 0) @ c + d

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 25, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Scorer:
    """Minimise the non-negative unbiased risk with the logistic loss.

    With l the loss, the risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]). Where a batch makes the
    second part negative, the step goes against that part alone, so that it rises again.
    """
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    d = unlabelled.shape[1]
    net = Scorer(mean, scale, [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(1)])
    p_all, u_all = net.standard(positive), net.standard(unlabelled)
    m, v, t = [0.0] * 4, [0.0] * 4, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        order = rng.permutation(len(u_all))
        for i in range(0, len(u_all), batch):
            u = u_all[order[i : i + batch]]
            p = p_all[rng.integers(0, len(p_all), len(u))]
            a, b, c, e = net.layers
            x = np.concatenate([p, u])
            h = np.maximum(x @ a + b, 0)
            g = h @ c + e
            gp, gu = g[: len(p)], g[len(p) :]
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            dneg = np.concatenate([-prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)])
            dpos = np.concatenate([-prior * sigmoid(-gp) / len(p), np.zeros(len(u))])
            dg = dpos + dneg if negative >= 0 else -dneg
            dh = dg[:, None] * c * (h > 0)
            grads = [x.T @ dh + decay * a, dh.sum(0), h.T @ dg + decay * c, dg.sum(keepdims=True)]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net.layers[k] = net.layers[k] - rate * 0.9**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def prior_from_scores(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior where no negative is labelled: a classifier of labelled against unlabelled scores s = P(labelled);
    on positives s is near a constant c, so the unlabelled share is the mean of (s / c) * (1 - c) / (1 - s), at most 1."""
    net = fit_pu(positive, np.concatenate([positive, unlabelled]), len(positive) / (len(positive) + len(unlabelled)), epochs=8)
    s, c = np.clip(net.score(unlabelled), 1e-3, 1 - 1e-3), np.clip(net.score(positive).mean(), 1e-3, 1 - 1e-3)
    return float(np.clip((s / c * (1 - c) / (1 - s)).mean(), 0.05, 0.98))


def held_out(id_col: str = "doc_id", modulus: int = 3, left_out: int = 1) -> Column:
    """Rows whose labels no training may see; a null id is not held out (and not learnt from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == left_out, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"x": [np.array(features_of(t), np.float64).tobytes() for t in pdf["text"]], "positive": pdf["positive"]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Fit to positives (quality 1) and unlabelled documents, none of them held out.

    Of more than `sample` positives or documents about that many are taken, picked by a hash of the id. The class prior
    is the share of positives among labelled documents; if no negative is labelled, it is estimated from scores.
    Null or contradicting labels count by their mean for an id. None if there is no positive.
    """
    learnable = F.col("doc_id").isNotNull() & ~held_out()
    known = labels.where(learnable & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    total, good = known.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0))).first()
    if not good:
        return None
    pick = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003.0 * sample / max(n, 1)
    trusted = known.where(F.col("good") & pick(good)).select("doc_id", F.lit(True).alias("positive"))  # about `sample` ids
    rows = docs.where(learnable).select("doc_id", "text")
    n = rows.count()
    rows = rows.join(F.broadcast(trusted), "doc_id", "left").withColumn("open", pick(n)).where(F.col("positive") | F.col("open"))
    both = rows.select("text", F.explode(F.expr("filter(array(if(positive, true, null), if(open, false, null)), x -> x is not null)")).alias("positive"))
    pdf = both.mapInPandas(_features, "x binary, positive boolean").toPandas().sort_values(["positive", "x"])
    x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(len(pdf), -1)
    positive, unlabelled = x[pdf["positive"].to_numpy()], x[~pdf["positive"].to_numpy()]
    if not len(positive) or not len(unlabelled):
        return None
    prior = good / total if good < total else prior_from_scores(positive, unlabelled)
    return fit_pu(positive, unlabelled, prior)


def with_quality(docs: DataFrame, scorer: Scorer | None, column: str, text_col: str = "text") -> DataFrame:
    """docs with a double `column`: how likely each whole text is a good one, 0 to 1 (0.5 for all without a scorer).

    Null and empty texts are scored by their (zero) statistics. All rows and columns stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model.value is None or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(model.value.score(np.array([features_of(t) for t in texts])))

    return docs.withColumn(column, pandas_udf(score, "double")(F.col(text_col)))
