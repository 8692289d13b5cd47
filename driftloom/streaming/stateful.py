"""Operators with state for each stream: detectors, an online learner and sliding windows, row by row in the order of seq.

State is kept in typed values, lists and maps of the state store, so it grows and is read by what changes. The session needs
the RocksDB state store (see use_state_store). A stream's rows come in the order of micro-batches; rows of one micro-batch
are put in order of seq before they reach the processor, however many there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftloom.operators.bayes import WIDTH, joint_log
from driftloom.operators.detectors import Chain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Puts the state of streaming queries that start from now on into RocksDB, of which batches write what they changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key's micro-batch by seq. Batches that follow each other already pass through one by one; from the first
    that does not, the rest of this micro-batch is put in order together."""
    last, held = None, []
    for pdf in batches:
        pdf = pdf.sort_values("seq", kind="stable")
        if held or (last is not None and len(pdf) and pdf["seq"].iloc[0] < last):
            held.append(pdf)
        elif len(pdf):
            last = pdf["seq"].iloc[-1]
            yield pdf
    if held:
        yield pd.concat(held).sort_values("seq", kind="stable")


class DetectorProcessor(StatefulProcessor):
    """Drifts of one detector; its state is one value."""

    def __init__(self, detector: str, grace: int):
        self.detector, self.grace = detector, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "chain binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        chain = pickle.loads(self.chain.get()[0]) if self.chain.exists() else Chain(self.detector, self.grace)
        for pdf in _in_order(rows):
            found = [(key[0], *f) for s, e in zip(pdf["seq"], pdf["err"], strict=True) if (f := chain.update(int(s), int(e)))]
            if found:
                yield pd.DataFrame(found, columns=["stream_id", "warned_at", "detected_at"])
        self.chain.update((pickle.dumps(chain),))

    def close(self) -> None:
        pass


class BayesProcessor(StatefulProcessor):
    """Predictions of naive Bayes from the rows before; its state is a map from each class to its count, sums and squares."""

    def __init__(self, features: Sequence[str], label_type: str, width: float):
        self.features, self.label_type, self.width = list(features), label_type, width
        self.plain = int if label_type in ("tinyint", "smallint", "int", "bigint") else (lambda v: v)  # nulls make whole numbers floats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.classes = handle.getMapState("classes", f"label {self.label_type}", "n double, sums array<double>, squares array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = {k[0]: [v[0], list(v[1]), list(v[2])] for k, v in self.classes.iterator()}
        touched = set()
        for pdf in _in_order(rows):
            out = []
            for seq, label, *x in pdf[["seq", "label", *self.features]].itertuples(index=False):
                label, x = None if pd.isna(label) else self.plain(label), [float(v) for v in x]
                whole = label is not None and not any(pd.isna(v) for v in x)
                best = None
                if known and not any(pd.isna(v) for v in x):
                    scores = {c: joint_log(*state, x, self.width) for c, state in known.items()}
                    best = min(known, key=lambda c: (-scores[c], c))
                out.append((key[0], seq, label, best, int(best is None or best != label)))
                if whole:
                    n, sums, squares = known.get(label, (0.0, [0.0] * len(x), [0.0] * len(x)))
                    known[label] = [n + 1, [s + v for s, v in zip(sums, x, strict=True)], [q + v * v for q, v in zip(squares, x, strict=True)]]
                    touched.add(label)
            yield pd.DataFrame(out, columns=["stream_id", "seq", "label", "predicted", "err"]).astype({"label": object, "predicted": object})
        for label in touched:
            self.classes.updateValue((label,), tuple(known[label]))

    def close(self) -> None:
        pass


class SlidingProcessor(StatefulProcessor):
    """Means of the last `size` values every `step` rows; its state is the list of these values and the number of rows so far.

    With idle_ms, a stream without rows for so long (processing time) is forgotten by a timer.
    """

    def __init__(self, size: int, step: int, idle_ms: int | None):
        self.size, self.step, self.idle_ms = size, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [v[0] for v in self.values.get()] if self.values.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in _in_order(rows):
            out = []
            for seq, value in zip(pdf["seq"], pdf["value"], strict=True):
                held.append(float(value))
                n += 1
                if n >= self.size and (n - self.size) % self.step == 0:
                    part = held[-self.size :]
                    out.append((key[0], (n - self.size) // self.step, int(seq), sum(part) / self.size))
            held = held[-self.size :]
            if out:
                yield pd.DataFrame(out, columns=["stream_id", "win", "last", "mean"])
        self.values.put([(v,) for v in held])
        self.seen.update((n,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.values.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def detect_stream(errors: DataFrame, detector: str = "ddm", grace: int = 100) -> DataFrame:
    """(stream_id, warned_at, detected_at) as errors (stream_id, seq, err) arrive; the same as the batch fold (detectors.detect)."""
    return errors.groupBy("stream_id").transformWithStateInPandas(DetectorProcessor(detector, grace), "stream_id string, warned_at long, detected_at long", "append", "none")


def prequential_stream(rows: DataFrame, features: Sequence[str], width: float = WIDTH) -> DataFrame:
    """(stream_id, seq, label, predicted, err) as rows (stream_id, seq, label, features) arrive; the same as bayes.prequential."""
    kind = rows.schema["label"].dataType.simpleString()
    processor = BayesProcessor(features, kind, width)
    return rows.groupBy("stream_id").transformWithStateInPandas(processor, f"stream_id string, seq long, label {kind}, predicted {kind}, err int", "append", "none")


def sliding_windows(rows: DataFrame, size: int, step: int, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, win, last, mean) of rows (stream_id, seq, value): window win holds `size` rows from row win * step on, as soon as
    its last row (seq `last`) arrives. With idle_ms, streams are forgotten after so long without rows; such a query waits for its
    timers, so a run of what is available now would not end."""
    mode = "none" if idle_ms is None else "processingTime"
    return rows.groupBy("stream_id").transformWithStateInPandas(SlidingProcessor(size, step, idle_ms), "stream_id string, win long, last long, mean double", "append", mode)
