"""Ranked search by words: an inverted treap for each term, traversed for all terms of a query at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .decontamination import WORD_BYTES
from .storage import batch_rows, give_back, materialize, release

#: Bytes of text split at once; rows that a worker gets at a time.
BLOCK_BYTES, TEXT_ROWS, COUNT_ROWS = 1 << 20, 1000, 20_000
#: Most bytes of query texts that go to all workers at once, and queries that a treap is searched for at once.
MAX_QUERY_BYTES, QUERIES_AT_ONCE = 16_000_000, 1000
#: Postings of one set of treaps, and nodes of open intervals that are expanded together.
SHARD_POSTINGS, OPEN_NODES = 4_000_000, 400_000


def terms_of(text: str | None) -> Counter:
    """Occurrences of each term: runs of 0-9, A-Z, a-z and all beyond ASCII, with A-Z as a-z; as UTF-8."""
    counts: Counter = Counter()
    raw = text.encode().translate(WORD_BYTES) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK_BYTES)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight."""
    m = 10 + (90 * n_terms * n_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _nearest_larger(key: np.ndarray, group: np.ndarray, strictly: bool) -> np.ndarray:
    """The closest place to the left, in the same group, with a larger key (or an equal one, if not strictly); -1 if none.

    All places between a place and the one it points at hold smaller keys, so a pointer may jump along pointers.
    """
    at = np.arange(-1, len(key) - 1)
    open_ = np.arange(len(key))
    while len(open_):
        to = at[open_]
        inside = (to >= 0) & (group[to] == group[open_])
        at[open_[~inside]] = -1
        open_, to = open_[inside], to[inside]
        lower = (key[to] <= key[open_]) if strictly else (key[to] < key[open_])
        open_, to = open_[lower], to[lower]
        at[open_] = at[to]
    return at


@dataclass
class Treaps:
    """Treaps of all terms over one set of documents: nodes lie by (term, place of the document), parents have larger impacts.

    Equal impacts are ordered at random, so that lists of them stay shallow.
    """

    term: np.ndarray
    place: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: dict[int, int]
    key: np.ndarray
    n_places: int

    @classmethod
    def of(cls, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n_places: int) -> Treaps:
        order = np.lexsort((place, term))
        term, place, impact = term[order].astype(np.int64), place[order].astype(np.int64), impact[order]
        n = len(term)
        heap = (impact << 20) | np.random.default_rng(n).integers(0, 1 << 20, n)
        before = _nearest_larger(heap, term, False)  # of equal ones the leftmost is the upper
        after = n - 1 - _nearest_larger(heap[::-1], term[::-1], True)[::-1]
        after[after == n] = -1
        left, right = np.full(n, -1), np.full(n, -1)
        mine = np.arange(n)
        to_left = (before >= 0) & ((after < 0) | (heap[before] < heap[after]))  # the parent is the smaller of the two
        right[before[to_left]] = mine[to_left]
        to_right = (after >= 0) & ~to_left
        left[after[to_right]] = mine[to_right]
        top = np.flatnonzero((before < 0) & (after < 0))
        return cls(term, place, impact, left, right, dict(zip(term[top].tolist(), top.tolist(), strict=True)), term * n_places + place, n_places)

    def part_roots(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each subtree its node of largest impact with a place from low to high; -1 if it has none there."""
        now, open_ = nodes.copy(), np.arange(len(nodes))
        while len(open_):
            at = now[open_]
            place = self.place[at]
            over, under = place > high[open_], place < low[open_]
            moved = over | under
            open_, at, over = open_[moved], at[moved], over[moved]
            to = np.where(over, self.left[at], self.right[at])
            now[open_] = to
            open_ = open_[to >= 0]
        return now

    def impacts_at(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Impacts of terms in documents; 0 where a document hasn't the term."""
        want = terms * self.n_places + places
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0)


class Best:
    """The k best documents of each query so far: larger scores first, then smaller ids, null ids last."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.no_id = np.zeros(0, bool)
        self.bar, self.bar_id, self.bar_no_id = np.zeros(n_queries, np.int64), np.full(n_queries, np.iinfo(np.int64).min), np.zeros(n_queries, bool)

    def beats(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Whether a document with this score and id would enter."""
        bar_no = self.bar_no_id[query]
        earlier = (no_id < bar_no) | ((no_id == bar_no) & (id_ < self.bar_id[query]))
        return (score > self.bar[query]) | ((score == self.bar[query]) & earlier)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, no_id: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        id_, no_id = np.concatenate([self.id, id_]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((id_, no_id, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, self.query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.score, self.id, self.no_id = score[order], id_[order], no_id[order]
        full = rank == self.k - 1
        q = self.query[full]
        self.bar[q], self.bar_id[q], self.bar_no_id[q] = self.score[full], self.id[full], self.no_id[full]


def search_treaps(treaps: Treaps, ids: np.ndarray, no_id: np.ndarray, queries: list[np.ndarray], weight: np.ndarray, best: Best) -> int:
    """Enter the documents of these treaps that belong to the k best of any query; returns how many were scored.

    An open interval of places holds, for each term of its query, the subtree's root there. The sum of their weighted
    impacts bounds the score of every document in it: intervals whose bound can't enter the k best go. In the others the
    document of the largest weighted root is scored in full and splits the interval in two. Each split descends only to
    the next root within its half.
    """
    start = [(q, r) for q, terms in enumerate(queries) for t in terms.tolist() if (r := treaps.roots.get(t)) is not None]
    if not start:
        return 0
    query, size = np.unique(np.array([q for q, _ in start]), return_counts=True)
    low, high = np.zeros(len(query), np.int64), np.full(len(query), treaps.n_places - 1)
    stack, scored = [(query, low, high, size, np.array([r for _, r in start]))], 0
    while stack:
        query, low, high, size, node = stack.pop()
        worth = weight[treaps.term[node]] * treaps.impact[node]
        bound = np.add.reduceat(worth, np.cumsum(size) - size)
        alive = best.beats(query, bound, ids[low], no_id[low])
        inside = np.repeat(alive, size)
        query, low, high, size, node, worth = query[alive], low[alive], high[alive], size[alive], node[inside], worth[inside]
        if not len(query):
            continue
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        largest = np.flatnonzero(worth == np.maximum.reduceat(worth, first)[of])
        pivot = treaps.place[node[largest[np.searchsorted(of[largest], np.arange(len(size)))]]]

        term = treaps.term[node]
        score = np.add.reduceat(weight[term] * treaps.impacts_at(term, pivot[of]), first)
        scored += len(score)
        enters = best.beats(query, score, ids[pivot], no_id[pivot])
        if enters.any():
            best.add(query[enters], score[enters], ids[pivot[enters]], no_id[pivot[enters]])

        halves = []
        for lo, hi in ((low, pivot - 1), (pivot + 1, high)):
            some = np.flatnonzero((lo <= hi)[of])
            root = treaps.part_roots(node[some], lo[of[some]], hi[of[some]])
            there, some = root[root >= 0], some[root >= 0]
            count = np.bincount(of[some], minlength=len(size))
            full = count > 0
            halves.append((query[full], lo[full], hi[full], count[full], there))
        both = tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        ends = np.cumsum(both[3])
        cuts = np.searchsorted(ends, np.arange(OPEN_NODES, ends[-1] if len(ends) else 0, OPEN_NODES))
        for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
            if a < b:
                nodes = slice(ends[a] - both[3][a], ends[b - 1])
                stack.append((*(x[a:b] for x in both[:4]), both[4][nodes]))
    return scored


def _counter(vocabulary):
    """A column function text -> number of terms and the counts of those in the broadcast vocabulary."""

    @pandas_udf("n long, terms array<int>, counts array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for texts in batches:
            out = []
            for text in texts:
                counts = terms_of(text)
                mine = [(known[t], c) for t, c in counts.items() if t in known]
                out.append((counts.total(), [t for t, _ in mine], [c for _, c in mine]))
            yield pd.DataFrame(out, columns=["n", "terms", "counts"])
        give_back()

    return run


def _searcher(queries, weights, n_docs: int, all_terms: int, k: int, shard_postings: int):
    """Task: gather counted documents into treaps of bounded size and keep the k best of each query over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, weight = queries.value, weights.value
        groups = [asked[i : i + QUERIES_AT_ONCE] for i in range(0, len(asked), QUERIES_AT_ONCE)]
        bests = [Best(len(g), k) for g in groups]

        def search(parts: list[pd.DataFrame]) -> None:
            rows = pd.concat(parts)
            ids, no_id = rows["id"].to_numpy(), rows["no_id"].to_numpy()
            order = np.lexsort((ids, no_id))
            sizes = np.array([len(t) for t in rows["terms"]], np.int64)
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            count = np.concatenate(rows["counts"].to_list()).astype(np.int64)
            impact = impacts(count, np.repeat(rows["n"].to_numpy(), sizes), n_docs, all_terms)
            treaps = Treaps.of(np.concatenate(rows["terms"].to_list()), np.repeat(place, sizes), impact, len(rows))
            for group, best in zip(groups, bests, strict=True):
                search_treaps(treaps, ids[order], no_id[order], group, weight, best)

        parts, held = [], 0
        for rows in batches:
            parts.append(rows)
            held += int(rows["terms"].map(len).sum())
            if held >= shard_postings:
                search(parts)
                parts, held = [], 0
        if held:
            search(parts)
        for i, best in enumerate(bests):
            ids = pd.Series(best.id, dtype="Int64").mask(best.no_id)
            yield pd.DataFrame({"q": best.query + i * QUERIES_AT_ONCE, "id": ids, "score": best.score})
        give_back()

    return run


def _search_block(docs: DataFrame, asked: list[tuple], k: int, id_col: str, text_col: str, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries = [np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)), np.int64) for _, text in asked]
    counted = _counter(spark.sparkContext.broadcast(vocabulary))(F.col(text_col))
    with batch_rows(spark, TEXT_ROWS):
        number = F.col(id_col).cast("long")
        rows = docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"), counted.alias("c"))
        index = materialize(rows.select("id", "no_id", "c.*").where("n > 0"), "term-counts")
    n_docs, all_terms = index.agg(F.count("*"), F.sum("n")).first()
    df = {r.t: r.n for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # terms of the queries at most
    weights = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    sc = spark.sparkContext
    run = _searcher(sc.broadcast(queries), sc.broadcast(weights), n_docs, all_terms or 1, k, shard_postings)
    with batch_rows(spark, COUNT_ROWS):
        found = materialize(index.where(F.size("terms") > 0).mapInPandas(run, "q long, id long, score long"), "search-parts")
    release(index)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], f"q long, item_id {_kind(asked)}")
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _kind(asked: list[tuple]) -> str:
    return "string" if any(isinstance(item, str) for item, _ in asked) else "long"


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_QUERY_BYTES, shard_postings: int = SHARD_POSTINGS
) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for each row of queries (item_id, text).

    A score sums over the query's distinct terms weight * (10**9 * tf div (1000 * tf + 8 * m)), with the weight from the
    term's number of documents and m from the document's length against the mean (see term_weight, impacts). Numbers of
    documents and terms are counted over all documents. Equal scores are ranked by ascending id; ids are whole numbers.

    Each document's counts of query terms are written once. Every task makes treaps of its own documents, in sets of bounded
    size, and carries its bars from set to set, so postings are never shuffled; only k rows for each query and task are.
    Queries with more than max_bytes of text are taken in blocks of about that size, each against all documents.
    Null texts, and texts without a term, count nowhere and are never found; null ids come last among equal scores; each
    repeated row is ranked by itself; long texts are split block by block; empty tables and queries without a known term
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bench = queries.select("item_id", "text")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_bytes))
    found = None
    for b in range(blocks):
        asked = [(r.item_id, r.text) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        if asked:
            part = _search_block(docs, asked, k, id_col, text_col, shard_postings)
            found = part if found is None else found.unionByName(part)
    empty = f"item_id {dict(queries.dtypes)['item_id']}, rank int, doc_id long, score long"
    return spark.createDataFrame([], empty) if found is None else found
