import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftloom.llm.lexical_search import Best, Treaps, search, search_treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, c in counts:
            n = c.total()
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the of thin MIT license"), (2, "ound tion ver hat"), (3, None), (4, ""), (5, "neverseen zzz"), (6, "Ünïcödé ΣΑΣ 日本"), (7, "word"), (7, "lonely text"), (8, "the the the of"), (None, "blening hatted stre")]


def test_as_brute_force(spark, docs, texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = search(docs, items, 10)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(texts, ITEMS, 10)


def test_small_sets_and_blocks(spark, docs, texts):
    """Treaps of a few documents, few queries at once and many blocks of queries give the same rows."""
    items = spark.createDataFrame([(str(i), t) for i, t in ITEMS], "item_id string, text string")
    found = search(docs.coalesce(1), items, 3, max_bytes=40, shard_postings=300).collect()
    assert sorted(map(tuple, found), key=repr) == brute(texts, [(str(i), t) for i, t in ITEMS], 3)


def test_empty(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(no_docs, items).collect() == [] and search(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_treaps(seed):
    """Heap order by impact, search order by place, and the k best with few documents scored."""
    rng = np.random.default_rng(seed)
    n, n_terms = 20_000, 30
    share = 1 / np.arange(2, n_terms + 2) ** 2
    has = rng.random((n_terms, n)) < share[:, None]
    impact = np.where(has, rng.choice([5, 100, 1000, 10**6], (n_terms, n)) if seed % 2 else rng.integers(1, 10**6, (n_terms, n)), 0)
    term, place = np.nonzero(has)
    mix = rng.permutation(len(term))
    treaps = Treaps.of(term[mix], place[mix], impact[term, place][mix], n)
    for child, left in ((treaps.left, True), (treaps.right, False)):
        up = np.flatnonzero(child >= 0)
        down = child[up]
        assert (treaps.term[up] == treaps.term[down]).all() and (treaps.impact[up] >= treaps.impact[down]).all()
        assert ((treaps.place[down] < treaps.place[up]) == left).all()
    assert len(treaps.roots) == has.any(1).sum()
    assert (treaps.left >= 0).sum() + (treaps.right >= 0).sum() + len(treaps.roots) == len(term)

    weight = (1000 * np.log(1 / share)).astype(np.int64)
    queries = [np.array(random.Random(seed + i).sample(range(n_terms), 6)) for i in range(20)]
    best = Best(len(queries), 10)
    ids, no_id = np.arange(n) * 3, np.zeros(n, bool)
    scored = search_treaps(treaps, ids, no_id, queries, weight, best)
    for q, terms in enumerate(queries):
        score = (weight[terms, None] * impact[terms]).sum(0)
        want = np.lexsort((ids, -score))[:10]
        want = want[score[want] > 0]
        assert best.id[best.query == q].tolist() == ids[want].tolist() and best.score[best.query == q].tolist() == score[want].tolist()
    assert scored < 0.5 * n * len(queries)
