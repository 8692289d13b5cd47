"""Find benchmark passages in training documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .ngram_join import window_hashes, word_hashes
from .storage import free_name, give_back, materialize

#: Words that are not 0-9, A-Z, a-z or beyond ASCII separate; A-Z become a-z. On UTF-8 bytes this is one table.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Most bytes of benchmark text that one broadcast index is made of; the index holds about five times as many.
MAX_BROADCAST_BYTES = 32_000_000

FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, .. of size[k] numbers, for all k after each other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


@dataclass
class Windows:
    """Distinct windows of one length: sorted hashes, where the words of each lie, the items that hold it (owners from
    ends[k - 1] to ends[k]), and a mask of the hashes' low bits that most other windows miss."""

    hashes: np.ndarray
    at: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    mask: np.ndarray

    @classmethod
    def of(cls, size: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, words: np.ndarray) -> Windows:
        order = np.argsort(hashes, kind="stable")
        hashes, at, item = hashes[order], at[order], item[order]
        first = np.searchsorted(hashes, hashes)
        other = np.zeros(len(hashes), bool)
        for j in range(size):
            other |= words[at + j] != words[at[first] + j]
        kind = np.zeros(len(hashes), np.int64)  # windows of one hash that differ count as several
        for h in np.unique(hashes[other]):
            names: dict[bytes, int] = {}
            for k in range(np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")):
                kind[k] = names.setdefault(words[at[k] : at[k] + size].tobytes(), len(names))
        order = np.lexsort((item, kind, hashes))
        hashes, kind, at, item = hashes[order], kind[order], at[order], item[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (kind[1:] != kind[:-1])
        owned = new.copy()
        owned[1:] |= item[1:] != item[:-1]
        mask = np.zeros(1 << max(10, (16 * int(new.sum())).bit_length()), bool)
        mask[hashes & np.uint64(len(mask) - 1)] = True
        ends = np.add.reduceat(owned.astype(np.int64), np.flatnonzero(new)).cumsum()
        return cls(hashes[new], at[new], ends, item[owned], mask)


@dataclass
class Index:
    """Windows of benchmark items by length. Words have numbers; `words` holds those of all items after each other."""

    names: list[str]
    vocabulary: dict[bytes, int]
    words: np.ndarray
    windows: dict[int, Windows]

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> Index:
        names, vocabulary, numbers, parts, at = [], {}, [], {}, 0
        for item_id, text in rows:
            words = words_of(text)
            if item_id is None or not words:
                continue
            size = min(window, len(words))
            hashes = window_hashes(word_hashes(text, WORD_BYTES), size)
            parts.setdefault(size, []).append((hashes, at + np.arange(len(hashes)), np.full(len(hashes), len(names))))
            numbers.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            names.append(str(item_id))
            at += len(words)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        windows = {size: Windows.of(size, *(np.concatenate(x) for x in zip(*found, strict=True)), numbers) for size, found in parts.items()}
        return cls(names, vocabulary, numbers, windows)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them lie in a window of the index, and the items whose windows occur.

        Windows whose hash is in the index are verified word by word, each against the one distinct window of its hash.
        """
        hashes = word_hashes(text, WORD_BYTES) if text else np.zeros(0, np.uint64)
        edge, found, mine = np.zeros(len(hashes) + 1, np.int64), set(), None
        for size, known in self.windows.items():
            if len(hashes) < size:
                continue
            windows = window_hashes(hashes, size)
            maybe = np.flatnonzero(known.mask[windows & np.uint64(len(known.mask) - 1)])
            first = np.searchsorted(known.hashes, windows[maybe])
            count = np.searchsorted(known.hashes, windows[maybe], "right") - first
            if not count.any():
                continue
            if mine is None:
                mine = np.array([self.vocabulary.get(w, -1) for w in words_of(text)], np.int32)
            place, which = np.repeat(maybe, count), _ranges(first, count)
            same = np.ones(len(place), bool)
            for j in range(size):
                same &= mine[place + j] == self.words[known.at[which] + j]
            starts, which = np.unique(place[same]), np.unique(which[same])
            edge[starts] += 1
            edge[starts + size] -= 1
            begin = np.where(which > 0, known.ends[which - 1], 0)
            found.update(self.names[i] for i in np.unique(known.owners[_ranges(begin, known.ends[which] - begin)]).tolist())
        return len(hashes), np.cumsum(edge[:-1]) > 0, found


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))) if hit.any() else []
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanner(index):
    """A column function text -> FOUND for one broadcast index."""

    @pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts in batches:
            scanned = [index.value.scan(text) for text in texts]
            out = [(n, int(hit.sum()), sorted(found), _spans(hit)) for n, hit, found in scanned]
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])
            del texts, scanned, out
            give_back()

    return run


def _joined(sizes: pd.Series, parts: pd.Series, items: pd.Series) -> pd.DataFrame:
    """What several blocks of a benchmark found in one document."""
    out = []
    for n, spans, names in zip(sizes, parts, items, strict=True):
        hit = np.zeros(n, bool)
        for s in spans:
            hit[s["start"] : s["end"]] = True
        out.append((n, int(hit.sum()), sorted(set(names)), _spans(hit)))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])


def with_contamination(docs: DataFrame, benchmark: DataFrame, column: str, window: int = 10, text_col: str = "text", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs with a struct `column`: n_words, n_hit, items (ids as sorted strings) and spans of hit words (end exclusive).

    A window is `window` consecutive words of a benchmark item; a shorter item with words is one window. A document word
    within any occurrence of a window is hit. The index is broadcast if the benchmark's texts have max_bytes or fewer; a
    larger one is cut into blocks of about that size. Documents are then written once with a row number, scanned for each
    block, and only what was found is joined back.
    Null texts have no words; items without id or words match nothing; repeated rows are scanned each, whatever their
    length; an empty benchmark hits nothing. All columns of docs stay.
    """
    sc = docs.sparkSession.sparkContext
    bench = benchmark.select(F.col("item_id"), F.col("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_bytes))

    def scanner(block: DataFrame):
        return _scanner(sc.broadcast(Index.of([(r.item_id, r.text) for r in block.collect()], window)))(F.col(text_col))

    if blocks == 1:
        return docs.withColumn(column, scanner(bench))
    number = free_name(docs, "_row")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = None
    for k in range(blocks):
        part = rows.select(number, scanner(bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)).alias("f"))
        part = materialize(part.select(number, "f.*").where(F.lit(k == 0) | (F.col("n_hit") > 0)), "contamination")
        found = part if found is None else found.unionByName(part)
    each = found.groupBy(number).agg(F.max("n_words").alias("n"), F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))  # a row for each block at most
    each = each.select(number, pandas_udf(_joined, FOUND)("n", "s", "i").alias(column))
    return rows.join(each, number).select(*docs.columns, column)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_hit_share: float = 0.0) -> DataFrame:
    """docs without those of which more than min_hit_share of the words (and at least one) are hit. All columns stay."""
    name = free_name(docs, "_contamination")
    found = with_contamination(docs, benchmark, name, window)
    clean = F.col(name)["n_hit"] <= F.col(name)["n_words"] * min_hit_share
    return found.where(clean).select(*docs.columns)
