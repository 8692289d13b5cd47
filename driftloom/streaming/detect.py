"""Structured Streaming: windows by count, by time and by session, and detectors with state for each stream."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftloom.operators.detectors import DETECTORS, Chain


def _pack(chain: Chain) -> str:
    state = {k: list(v) if isinstance(v, deque) else v for k, v in vars(chain.detector).items()} if chain.detector else None
    return json.dumps([chain.warned_at, chain.last_warning, state])


def _unpack(name: str, grace: int, text: str) -> Chain:
    warned, last, state = json.loads(text)
    chain = Chain(name, grace, warned_at=warned, last_warning=last)
    if state is not None:
        chain.detector = DETECTORS[name]()
        for k, v in state.items():
            now = getattr(chain.detector, k)
            setattr(chain.detector, k, deque(v) if isinstance(now, deque) else tuple(v) if isinstance(now, tuple) else v)
    return chain


def detect_stream(errors: DataFrame, detector: str = "ddm", grace: int = 100) -> DataFrame:
    """(stream_id, warned_at, detected_at) as errors (stream_id, seq, err) arrive; a stream's rows must come in the order of
    micro-batches, within one they are sorted by seq."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = _unpack(detector, grace, state.get[0]) if state.exists else Chain(detector, grace)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], *f) for s, e in zip(rows["seq"], rows["err"], strict=True) if (f := chain.update(int(s), int(e)))]
        state.update((_pack(chain),))
        yield pd.DataFrame(out, columns=["stream_id", "warned_at", "detected_at"])

    return errors.groupBy("stream_id").applyInPandasWithState(fold, "stream_id string, warned_at long, detected_at long", "state string", "append", GroupStateTimeout.NoTimeout)


def count_windows(rows: DataFrame, size: int) -> DataFrame:
    """(stream_id, win, n, mean) of every `size` rows (stream_id, seq, value) of each stream, as they fill up."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        win, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for v in pd.concat(list(batches)).sort_values("seq")["value"]:
            n, total = n + 1, total + float(v)
            if n == size:
                out.append((key[0], win, n, total / n))
                win, n, total = win + 1, 0, 0.0
        state.update((win, n, total))
        yield pd.DataFrame(out, columns=["stream_id", "win", "n", "mean"])

    return rows.groupBy("stream_id").applyInPandasWithState(fold, "stream_id string, win long, n long, mean double", "win long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def time_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Class counts and mean value of tumbling or sliding event-time windows; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "label", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: stretches without a pause of `gap`."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "key").agg(F.count("*").alias("n")).select("key", "w.start", "w.end", "n")
