"""Pack documents into token sequences of a fixed length."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .storage import KEPT, batch_rows, give_back, materialize

#: Pieces that one packing task takes, words a worker remembers before it starts forgetting, texts it gets at a time.
PART_ITEMS, KNOWN_WORDS, TEXT_ROWS = 100_000, 300_000, 1000
#: Most characters of words that are merged together, and how many are; no merge.
LONG_WORD, MERGED_WORDS, NONE = 32, 20_000, 2**31 - 1

#: How this family of vocabularies splits text, and the printable characters that stand for bytes.
SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Signs that are one part at the end of a word of letters, whatever the letters are.
END_SIGNS = pa.array(list(".,;:!?)]}\"'"))
NOT_PLAIN = "[^\x00-\x1b\x20-\u012f]"  # the last four before the space are white space in some libraries only

class Merges:
    """The merges of a vocabulary, applied to many words at once: in each round every word merges its pair of lowest rank,
    the leftmost of equal ones, until no word has a pair left that merges."""

    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]], suffix: str):
        chars = [BYTE_CHARS[b] for b in range(256)]
        self.symbols = np.array([vocab[c] for c in chars] + [vocab[c + suffix] for c in chars], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], NONE << 32), np.append(order, NONE).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = self._ranks(self.symbols[:256, None], self.symbols[None])  # of pairs of bytes, the second maybe the last

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE).astype(np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        raw = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        width = int(sizes.max()) + 1
        place = np.arange(width)
        live = place < sizes[:, None]  # one row a word, one place a byte
        at = np.where(live, raw[np.minimum((ends - sizes)[:, None] + place, len(raw) - 1)], 0).astype(np.int32)
        at[np.arange(len(words)), sizes - 1] += 256
        rank = np.full(at.shape, NONE, np.int32)  # of the pair of a place and the next live one
        rank[:, :-1] = np.where(live[:, 1:], self.first[np.minimum(at[:, :-1], 255), at[:, 1:]], NONE)
        symbol = self.symbols[at]
        after = np.tile((place + 1).astype(np.int32), (len(words), 1))
        before = after - 2
        flat_symbol, flat_rank, flat_after, flat_before, flat_live = (x.ravel() for x in (symbol, rank, after, before, live))
        todo = np.arange(len(words))
        while len(todo):
            rows = rank[todo]
            column = rows.argmin(1)
            low = rows[np.arange(len(todo)), column]
            going = low < NONE
            todo, column, low = todo[going], column[going], low[going]
            start = todo * width
            here = start + column
            gone = start + flat_after[here]
            flat_symbol[here] = self.merged[low]
            flat_live[gone], flat_rank[gone], flat_rank[here] = False, NONE, NONE
            follows = flat_after[here] = flat_after[gone]
            has = follows < sizes[todo]
            right = (start + follows)[has]
            flat_before[right] = column[has]
            flat_rank[here[has]] = self._ranks(flat_symbol[here[has]], flat_symbol[right])
            has = flat_before[here] >= 0
            left = (start + flat_before[here])[has]
            flat_rank[left] = self._ranks(flat_symbol[left], flat_symbol[here[has]])
        return symbol[live].astype("<u4"), live.sum(1)


class Words:
    """Ids of texts by a vocabulary that drops white space, never joins across it and lower-cases. A text's ids are those
    of its white-space separated words in order; each distinct word of a batch of texts is looked up once.

    Lower-case letters and signs below U+0130 are the same in every normal form, so the parts of new words go straight to
    the merges, all together. Any other text, or one that may name a special token, takes the tokenizer's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])
        self.known, self.ids, self.ends = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the vocabulary's pattern does not split, and their counts; long ones are merged one by one."""
        long = {i: w for i, w in enumerate(parts) if len(w) > LONG_WORD}
        short = [w for w in parts if len(w) <= LONG_WORD] if long else parts
        done = [self.merges.encode(short[i : i + MERGED_WORDS]) for i in range(0, len(short), MERGED_WORDS)]
        ids = np.concatenate([np.zeros(0, "<u4"), *[x for x, _ in done]])
        counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in done]])
        if not long:
            return ids, counts
        found = iter(np.split(ids, np.cumsum(counts)[:-1]) if short else [])
        each = []
        for i, w in enumerate(parts):
            shown = i in long and "".join(map(BYTE_CHARS.__getitem__, w.encode()))
            each.append(np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4") if shown else next(found))
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where known words are, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words in a row, and where each word's end."""
        starts = np.concatenate([[0], self.ends[:-1]])[places]
        counts = self.ends[places] - starts
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - counts), counts) + np.arange(total)], ends

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Put new distinct words and their parts into memory; where the words are then."""
        alone = pc.utf8_is_alpha(words)
        odd = words.filter(pc.invert(alone))
        body, sign = pc.utf8_slice_codeunits(odd, 0, -1), pc.utf8_slice_codeunits(odd, -1)
        ended = pc.and_(pc.utf8_is_alpha(body), pc.is_in(sign, value_set=END_SIGNS))
        hard = odd.filter(pc.invert(ended))
        split = pc.split_pattern(pc.replace_substring_regex(hard, SPLIT, "\\1\n"), "\n")  # the last part is empty
        given = [words.filter(alone), body.filter(ended), sign.filter(ended), split.flatten()]
        parts = pa.concat_arrays(given).dictionary_encode()
        places = self._places(parts.dictionary)
        unknown = places < 0
        if unknown.any():
            new = parts.dictionary.filter(pa.array(unknown))
            places[unknown] = len(self.known) + np.arange(len(new))
            self._add(new, *self._merge(new.to_numpy(zero_copy_only=False).tolist()))
        whole, bodies, signs, rest = np.split(places[parts.indices.to_numpy()], np.cumsum([len(x) for x in given[:-1]]))
        out, alone, ended = np.empty(len(words), np.int64), alone.to_numpy(zero_copy_only=False), ended.to_numpy(zero_copy_only=False)
        out[alone] = whole
        odd_places = np.empty(len(odd), np.int64)
        odd_places[ended] = len(self.known) + np.arange(len(bodies))
        odd_places[~ended] = len(self.known) + len(bodies) + np.arange(len(hard))
        out[~alone] = odd_places
        ids, ends = self._gather(np.concatenate([np.column_stack([bodies, signs]).ravel(), rest]))
        bounds = np.concatenate([2 * np.arange(len(bodies)), 2 * len(bodies) + split.offsets.to_numpy() - split.offsets[0].as_py()])
        self._add(pa.concat_arrays([odd.filter(pa.array(ended)), hard]), ids, np.diff(np.concatenate([[0], ends])[bounds]))
        return out

    def _forget(self) -> None:
        """Drop the half of the words that was learnt first."""
        cut = len(self.known) // 2
        start, self.known = self.ends[cut - 1], pa.concat_arrays([pa.array([""]), self.known[cut:]])
        self.ids, self.ends = self.ids[start:], np.concatenate([[0], self.ends[cut:] - start])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers; none for null."""
        texts = texts.fill_null("")
        whole = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, NOT_PLAIN)).to_numpy(zero_copy_only=False)
        guarded = pa.concat_arrays([pc.if_else(pa.array(whole), "", texts), pa.array(["."])])  # Arrow reads behind a last text that ends in white space
        plain = pc.utf8_split_whitespace(pc.utf8_lower(guarded))[:-1]
        words = plain.flatten().dictionary_encode()
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        places = self._places(words.dictionary)
        if (places < 0).any():
            places[places < 0] = self._learn(words.dictionary.filter(pa.array(places < 0)))
        ids, ends = self._gather(places[words.indices.to_numpy()])
        cuts = np.concatenate([[0], ends])[plain.offsets.to_numpy() - plain.offsets[0].as_py()]
        out = np.split(ids, cuts[1:-1])
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out


def words_by(path: str) -> Words:
    """One vocabulary for each worker process."""
    if f"words {path}" not in KEPT:
        KEPT[f"words {path}"] = Words(path)
    return KEPT[f"words {path}"]


def tokenized(path: str, end_id: int, capacity: int):
    """A column function text -> lengths and checksums of the pieces of its ids."""

    @arrow_udf("array<struct<length:long,ids_crc32:long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        end, words = np.array([end_id], "<u4").tobytes(), words_by(path)
        for texts in batches:
            counts, lengths, sums = [0], [], []
            for found in words.encode(texts) if len(texts) else []:
                ids = found.tobytes() + end
                pieces = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
                counts.append(len(pieces))
                lengths += [len(p) // 4 for p in pieces]
                sums += map(zlib.crc32, pieces)
            pieces = pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["length", "ids_crc32"])
            give_back(f"words {path}")
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pieces)

    return run


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that these many items of each length need at least, by dual-feasible functions.

    Each function maps lengths so that what fits one bin sums to 1 at most: round up what leaves less than e, drop what
    is below e; or round down to multiples of 1/(k+1) and rescale, where exact multiples stay.
    """
    size = np.arange(len(counts), dtype=np.int64)
    share, best = size / capacity, -(-int(counts @ size) // capacity)
    for e in np.unique(size[(counts > 0) & (2 * size <= capacity)]):
        value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int(counts @ value) // capacity))
    for k in range(1, 41):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, share, (k + 1) * size // capacity / k)
        best = max(best, int(np.ceil(float(counts @ value) - 1e-6)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that still takes it."""
    bins, rooms = np.empty(len(lengths), np.int64), [[] for _ in range(capacity + 1)]
    open_, used = 0, 0  # bit r: a bin with room r is there
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fit = open_ >> n
        if fit:
            room = (fit & -fit).bit_length() - 1 + n
            at = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, at, used = capacity, used, used + 1
        bins[i] = at
        room -= n
        if room:
            rooms[room].append(at)
            open_ |= 1 << room
    return bins


PACKED = "uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, fill long, n_bins long, bound long"


def _pack(capacity: int, round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.fromiter(accumulate(lengths[order]), np.int64, len(order))
        fills = np.bincount(bins, lengths).astype(np.int64)
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - (np.cumsum(fills) - fills)[bins[order]]
        part = int(pdf["part"].iloc[0])
        return pdf.assign(sequence_id=(round_ << 56) + (part << 32) + bins, offset=offset, fill=fills[bins], n_bins=len(fills), bound=lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, part_items: int = PART_ITEMS, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed into as few sequences of at most `capacity` tokens as it can.

    A document is its ids and end_id; only a longer one is cut, into full pieces and a rest. Full pieces fill a sequence alone. The
    others are dealt evenly to parts of about part_items, each packed by best-fit decreasing. A dual-feasible lower
    bound certifies parts that cannot do better; the partly filled sequences of the others are dealt anew among each
    other and packed again, at most `rounds` times, and the result is kept if it saves sequences. Very long texts are
    read whole.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty (only end_id).
    Repeated rows and null ids each make pieces of their own. An empty table gives no rows. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = PACKED.format(id_type=id_type)
    cut = docs.select(F.col(id_col).alias("doc_id"), tokenized(tokenizer_path, end_id, capacity)(F.col(text_col)).alias("pieces"))
    cut = cut.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "p.length", "p.ids_crc32")
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        pieces = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")

    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    done, todo = [full.select(*result)], pieces.where(F.col("length") < capacity)
    waiting = todo.count()
    for k in range(rounds + 1):
        parts = -(-waiting // part_items)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(max(parts, 1))))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(capacity, k), schema), "packed")
        if k:
            count = lambda df: df.select("sequence_id").distinct().count()
            if count(packed) >= count(todo_before):
                done.append(todo_before.select(*result))
                break
        loose = (F.col("n_bins") > F.col("bound")) & (F.col("fill") < capacity)
        gaps = packed.where(loose).agg(F.count("*"), F.count_distinct("part")).first()
        if gaps[1] < 2 or k == rounds:
            done.append(packed.select(*result))
            break
        done.append(packed.where(~loose).select(*result))
        todo_before = packed.where(loose)
        todo, waiting = todo_before.select("uid", "doc_id", "piece", "start", "length", "ids_crc32"), gaps[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
