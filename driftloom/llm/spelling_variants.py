"""Words one edit apart, and the commoner spelling that each of them belongs to."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import batch_rows, give_back, materialize, release

#: Bytes of text split at once; texts and words that a worker gets at a time; words counted before they are passed on.
BLOCK_BYTES, TEXT_ROWS, WORD_ROWS, HELD_WORDS = 1 << 20, 1000, 20_000, 300_000
#: Words of one posting list (or of its askers) that one task meets at once.
LIST_WORDS = 2000

#: Letters are A-Z, a-z and U+00C0 to U+00FF: one byte each in Latin-1, where all others become a space and A-Z a-z.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

_LIST = ["grams", "pos", "gap", "len"]


def letter_runs(text: str | None) -> Counter:
    """Occurrences of each maximal run of letters, A-Z lower-cased, as Latin-1."""
    counts: Counter = Counter()
    raw = text.encode("latin-1", "replace").translate(LETTER_BYTES) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK_BYTES)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def damaged(run: bytes, seed: int, every: int) -> bytes:
    """The run without one letter, if its checksum (continued from seed) is a multiple of `every`."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _word_counter(min_chars: int, every: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            found = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
            held.clear()
            return found

        for rows in batches:
            for name, text in zip(rows["name"], rows["text"], strict=True):
                seed = crc32(f"{name}:".encode())
                for word, n in letter_runs(text).items():
                    if len(word) >= min_chars:
                        word = damaged(word, seed, every) if every else word
                        if len(word) >= min_chars:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()
        give_back()

    return run


def count_words(docs: DataFrame, min_chars: int = 6, min_count: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters of all texts with at least min_chars letters and min_count occurrences.

    With `every`, runs whose checksum with their document's id (a null id is empty) is a multiple of it lose one letter.
    Tasks sum up what they see of a word first, so a word that fills the corpus is a few rows of the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    counts = rows.mapInPandas(_word_counter(min_chars, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether b comes from a (as long, or longer by one) by replacing or deleting exactly one letter."""
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:])


def near_in_list(indexed: list[tuple[str, int]], asking: list[tuple[str, int]], q: int, shared: tuple[int, ...] = ()) -> Iterator[tuple[str, int, str, int]]:
    """Pairs (a, its n, b, its n) one edit apart of an asking word a and an indexed word b.

    Indexed words have one length, asking words the same or one more. All are known to share the grams at the places `shared`
    of the indexed words. Postings of the other grams by position are merged in a heap for each asking word, the shortest
    first, under the positions that one edit allows: the same, or one more where the asking word is longer. Words that come
    up as often as one edit leaves grams intact are verified; an asking word with fewer lists than that has none.
    """
    size = len(indexed[0][0])
    places = [p for p in range(size - q + 1) if p not in shared]
    postings: list[defaultdict[str, list[int]]] = [defaultdict(list) for _ in places]
    for at, (word, _) in enumerate(indexed):
        for p, lists in zip(places, postings, strict=True):
            lists[word[p : p + q]].append(at)
    lookups = [(p, lists.get) for p, lists in zip(places, postings, strict=True)]
    for a, n in asking:
        longer = len(a) > size
        bound = len(a) - 2 * q + 1 - len(shared)
        lists = [found for p, get in lookups if (found := get(a[p : p + q]))]
        if longer:
            lists += [found for p, get in lookups if (found := get(a[p + 1 : p + 1 + q]))]
        if len(lists) < bound:
            continue
        if bound < 1:
            few, rest = [range(len(indexed))], []
        else:  # words with `bound` grams are in one of all but the bound - 1 longest lists, which are only looked up
            lists.sort(key=len)
            few, rest = lists[: len(lists) - bound + 1], lists[len(lists) - bound + 1 :]
        for at, same in groupby(heapq.merge(*few) if len(few) > 1 else few[0]):
            b, m = indexed[at]
            if (longer or a > b) and sum(1 for _ in same) + sum(_holds(x, at) for x in rest) >= bound and one_edit(a, b):
                yield a, n, b, m


def _holds(places: list[int], at: int) -> bool:
    i = bisect_left(places, at)
    return i < len(places) and places[i] == at


def _list_joiner(q: int):
    """Task: rows come in order of their list and block; each block is held while its pairs are made."""

    shared = lambda key: (key[1] - 1, key[1] + key[2] - 1)  # places of the two grams of a list

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sides = None, ([], [])
        for rows in batches:
            found = []
            keys = zip(*(rows[c] for c in (*_LIST, "i", "a")), strict=True)
            for key, asks, word, n in zip(keys, rows["asks"], rows["word"], rows["n"], strict=True):
                if key != now:
                    found += near_in_list(*sides, q, shared(now)) if sides[0] and sides[1] else []
                    now, sides = key, ([], [])
                sides[asks].append((word, n))
            yield pd.DataFrame(found, columns=["a", "n_a", "b", "n_b"])
        found = list(near_in_list(*sides, q, shared(now))) if sides[0] and sides[1] else []
        yield pd.DataFrame(found, columns=["a", "n_a", "b", "n_b"])
        give_back()

    return run


def gram_size(min_chars: int) -> int:
    """The longest grams of which one edit always leaves two intact in words of min_chars letters."""
    if min_chars < 3:
        raise ValueError("words of fewer than 3 letters have no two grams that one edit leaves intact")
    return 2 if min_chars >= 5 else 1


def near_words(words: DataFrame, min_chars: int = 6, list_words: int = LIST_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of distinct words of (word, n) one edit apart, once; a is the longer or the later.

    One edit leaves all but q of the longer word's positional grams of q letters intact. So of the q + 2 rarest grams of
    both words two are shared: only pairs of these are posted, under both grams, their positions and the word's length.
    Every word asks for its own pairs as they stand and as one deleted letter shifts them. A list with more than list_words
    words or askers is cut into blocks of that many, each meeting each, so no task holds a whole frequent list and none is
    cut short. Words need min_chars letters or more. They must be distinct; repeated ones would pair as often.
    """
    q, size = gram_size(min_chars), F.char_length("word")
    grams = words.select("word", "n", size.alias("len"), F.explode(F.sequence(F.lit(1), size - (q - 1))).alias("pos")).withColumn("gram", F.substring("word", F.col("pos"), F.lit(q)))
    shares = grams.groupBy("gram").agg(F.count("*").alias("words"))  # at most 90**2 grams exist, whatever the corpus
    ranked = grams.join(F.broadcast(shares), "gram").groupBy("word").agg(F.first("n").alias("n"), F.first("len").alias("len"), F.array_sort(F.collect_list(F.struct("words", "gram", "pos"))).alias("grams"))
    rare = F.array_sort(F.transform(F.slice("grams", 1, q + 2), lambda g: F.struct(g["pos"].alias("pos"), g["gram"].alias("gram"))))
    pair = lambda x, y: F.struct(F.concat(x["gram"], y["gram"]).alias("grams"), x["pos"].alias("pos"), (y["pos"] - x["pos"]).alias("gap"))
    pairs = F.flatten(F.transform("rare", lambda x, k: F.transform(F.slice("rare", k + 2, q + 2), lambda y: pair(x, y))))
    posted = ranked.withColumn("rare", rare).select("word", "n", "len", F.explode(pairs).alias("p")).select("p.*", "word", "n", "len")

    place = lambda pos, gap, shorter, asks: F.struct((F.col("pos") - pos).alias("pos"), (F.col("gap") - gap).alias("gap"), (F.col("len") - shorter).alias("len"), F.lit(asks).alias("asks"))
    places = F.explode(F.array(place(0, 0, 0, 0), place(0, 0, 0, 1), place(0, 0, 1, 1), place(0, 1, 1, 1), place(1, 0, 1, 1)))
    rows = posted.select("grams", "word", "n", places.alias("at")).select("grams", "at.*", "word", "n")
    rows = materialize(rows.where(f"pos > 0 AND gap > 0 AND len >= {int(min_chars)}"), "gram-lists")
    parts = lambda asks: F.ceil(F.sum((F.col("asks") == asks).cast("int")) / list_words).cast("int")
    # lists that nobody else asks for, or that hold nothing, go; long ones are cut
    lists = rows.groupBy(*_LIST).agg(parts(0).alias("n_i"), parts(1).alias("n_a"), F.count("*").alias("held")).where("n_i > 0 AND n_a > 0 AND held > 2").drop("held")
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = rows.join(lists, _LIST).withColumn("i", F.explode(F.when(F.col("asks") == 0, F.array(mine("n_i"))).otherwise(all_("n_i"))))
    cut = cut.withColumn("a", F.explode(F.when(F.col("asks") == 1, F.array(mine("n_a"))).otherwise(all_("n_a"))))
    block = [*_LIST, "i", "a"]
    dealt = cut.select(*block, "asks", "word", "n").repartition(*block).sortWithinPartitions(*block)
    with batch_rows(words.sparkSession, WORD_ROWS):
        pairs = materialize(dealt.mapInPandas(_list_joiner(q), "a string, n_a long, b string, n_b long").distinct(), "near-words")
    release(rows)
    return pairs


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles how far a word has followed its forms."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def group_variants(words: DataFrame, min_chars: int = 6, factor: int = 5, list_words: int = LIST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of (word, n) with at least min_chars letters.

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is its near word of largest n (ties:
    first in code-point order), if that n is at least `factor` times the word's; its root is where following forms ends (the
    word itself without a form). n grows by `factor` with each step, so chains are short.
    An empty table gives no rows. All words stay, those without near words too.
    """
    pairs = near_words(words, min_chars, list_words)
    both = pairs.select("a", "n_a", "b", "n_b").unionAll(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "near", "near_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= factor * F.col("n")
    marked = words.join(best, "word", "left").select(
        "word", F.when(large, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, -F.col("best.less")).alias("form_n")
    )
    marked = materialize(marked, "variants")
    release(pairs)
    roots = _roots(marked.where(F.col("form").isNotNull()))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, factor: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group_variants of the words of docs (see count_words).

    Null and empty texts have no words; repeated rows count each time; long texts are counted block by block; a document of
    any length costs no more memory than its text and its distinct words. Other columns are not read.
    """
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        words = materialize(count_words(docs, min_chars, min_count, every, id_col, text_col), "words")
    return group_variants(words, min_chars, factor)
