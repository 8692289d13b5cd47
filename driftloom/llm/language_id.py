"""Language of documents, by a small convolutional network over bytes that is trained here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .storage import batch_rows, free_name, give_back

WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 12, 8
#: Most labelled documents of one language, and windows of one document, that training takes.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 1200, 3
#: Passes over the sample, and batches that training takes at least, however small the sample is.
EPOCHS, LEAST_STEPS = 8, 600
UNKNOWN = "und"
#: Texts that Python workers get at a time in training.
TEXT_ROWS = 1000


def windows_of(text: str) -> np.ndarray:
    """The whole lower-cased text as rows of WINDOW bytes; the last row ends in zeros."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, WINDOW)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class ByteNet:
    """Embedding, filters of several widths, the largest response of each over a window, softmax."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        params = {"embed": draw(256, DIMS, scale=0.5), "out": draw(len(WIDTHS) * FILTERS, len(languages), scale=0.1), "bias": np.zeros(len(languages), np.float32)}
        params |= {f"conv{w}": draw(w, DIMS, FILTERS, scale=0.5 / np.sqrt(w)) for w in WIDTHS}
        return cls(languages, params)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it is."""
        best, where = [], []
        for w in WIDTHS:
            taps = self.params["embed"] @ self.params[f"conv{w}"]  # (w, 256, FILTERS)
            z = sum(taps[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            at = z.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy of a batch and its gradients."""
        h, where = self.pooled(x)
        logits = h @ self.params["out"] + self.params["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(y)), y] + 1e-9).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        grads = {"out": h.T @ p, "bias": p.sum(0), "embed": np.zeros_like(self.params["embed"])}
        dh = p @ self.params["out"].T
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            g, at, conv = dh[:, part], where[:, part], self.params[f"conv{w}"]
            grads[f"conv{w}"] = np.zeros_like(conv)
            for j in range(w):
                bytes_ = x[rows, at + j]  # (batch, FILTERS)
                grads[f"conv{w}"][j] = np.einsum("nf,nfd->df", g, self.params["embed"][bytes_])
                np.add.at(grads["embed"], bytes_, g[:, :, None] * conv[j].T[None])
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteNet:
        """Adam over shuffled batches, in more epochs if these make fewer than LEAST_STEPS."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        asked, epochs = epochs, max(epochs, -(-LEAST_STEPS // -(-len(y) // batch)))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick, t = order[i : i + batch], t + 1
                for name, g in self.step(x[pick], y[pick])[1].items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    move = m[name] / (1 - 0.9**t) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
                    self.params[name] -= (rate * 0.7 ** (epoch * asked / epochs) * move).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """Responses to all pairs of bytes, so that a filter needs at most two look-ups at a place."""
        a, b, c = (self.params["embed"] @ self.params[f"conv{w}"] for w in WIDTHS)
        pair = lambda s, t: (s[:, None] + t[None]).reshape(65536, FILTERS)
        return {"w2": pair(a[0], a[1]), "w3": pair(b[0], b[1]), "w3c": b[2], "w4": pair(c[0], c[1]), "w4c": pair(c[2], c[3])}

    def logits(self, x: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        h = np.concatenate([
            tables["w2"][pairs].max(1),
            (tables["w3"][pairs[:, :-1]] + tables["w3c"][x[:, 2:]]).max(1),
            (tables["w4"][pairs[:, :-2]] + tables["w4c"][pairs[:, 2:]]).max(1),
        ], 1)
        return h @ self.params["out"] + self.params["bias"]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability from all windows of each whole text, weighted by the bytes they hold."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        spoken = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        tables, at = self.tables() if spoken else None, 0
        while at < len(spoken):
            rows, counts, stop = [], [], at
            while stop < len(spoken) and (stop == at or sum(counts) < 512):
                rows.append(windows_of(texts[spoken[stop]]))
                counts.append(len(rows[-1]))
                stop += 1
            x = np.concatenate(rows)
            out = np.concatenate([self.logits(x[i : i + 256], tables) for i in range(0, len(x), 256)])
            weight = np.maximum((x != 0).sum(1), 1).astype(np.float64)
            starts = np.cumsum([0, *counts[:-1]])
            mean = np.add.reduceat(out * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, q in zip(spoken[at:stop], p.argmax(1), p.max(1), strict=True):
                names[i], scores[i] = self.languages[k], float(q)
            at = stop
        return names, scores


def _some_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            if has_letter(text):
                rows = windows_of(text)
                for i in np.unique(np.linspace(0, len(rows) - 1, min(len(rows), WINDOWS_PER_DOC)).astype(int)):
                    out.append((rows[i].tobytes(), lang))
        yield pd.DataFrame(out, columns=["window", "lang"])


def held_out(id_col: str = "doc_id", modulus: int = 4, left_out: int = 2) -> Column:
    """Rows that no training may see; a null id is not held out (and not learnt from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == left_out, F.lit(False))


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, seed: int = 7) -> ByteNet:
    """Fit a network to documents with a language that are not held out.

    Of a language with more than per_language documents about that many are taken, picked by a hash of the id; of each
    up to WINDOWS_PER_DOC windows spread over the whole text reach the driver. Ties in the order of windows are equal
    windows. Repeated rows count each; an empty table gives a network without languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count()
    wanted = known.join(F.broadcast(counts.where("count > 0")), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(1_000_003.0 * per_language) / F.col("count"))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        rows = wanted.select("text", "lang").mapInPandas(_some_windows, "window binary, lang string").toPandas()
    languages = sorted(rows["lang"].unique())
    net = ByteNet.fresh(languages, seed)
    if len(languages) > 1:
        rows = rows.sort_values(["lang", "window"], ignore_index=True)
        x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(len(rows), WINDOW)
        net.fit(x, np.searchsorted(languages, rows["lang"]), seed=seed)
    return net


def with_language(docs: DataFrame, net: ByteNet, column: str, text_col: str = "text") -> DataFrame:
    """docs with a struct `column`: lang_pred and score (its probability).

    Every text is read whole, in windows of WINDOW bytes. A text that is null or has no letter gets `und` and score 0;
    so do all texts if nothing could be learnt. Ties go to the first language by name. All rows and columns stay,
    repeated rows are read each, and an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts in batches:
            names, scores = model.value.predict([None if t is None else str(t) for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})
            del texts, names, scores
            give_back()

    return docs.withColumn(column, pandas_udf(predict, "lang_pred string, score double")(F.col(text_col)))


def keep_spoken(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """docs without those that have no letter or whose best language is less likely than min_score."""
    name = free_name(docs, "_language")
    found, at = with_language(docs, train(docs), name), F.col(name)
    return found.where((at["lang_pred"] != UNKNOWN) & (at["score"] >= min_score)).select(*docs.columns)
