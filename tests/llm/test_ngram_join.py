import random
import re
from collections import Counter

import pytest

from driftloom.llm import ngram_join as nj
from driftloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return Counter((d, len(s), smallest.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, docs, texts, k, percent):
    out = nj.link_documents(docs, k, percent)
    assert Counter(map(tuple, out.collect())) == brute(texts, k, percent)


@pytest.mark.parametrize(("common", "sent"), [(50, True), (2, True), (2, False)])
def test_shared_passages_and_chains(spark, monkeypatch, common, sent):
    if not sent:
        monkeypatch.setattr(nj, "MAX_BROADCAST_COMMON", 0)
        monkeypatch.setattr(nj, "MAX_BROADCAST_NODES", 0)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(4, 30))] + passage + [word() for _ in range(8)])) for i in range(60)]
    base = passage + [word() for _ in range(60)]
    for i in range(40):  # a chain of edits: neighbours link, the ends don't
        base = base[:]
        base[rng.randrange(len(base))] = word()
        rows.append((1000 - i, " ".join(base)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = nj.link_documents(frame, 4, 85, common=common)
    assert Counter(map(tuple, out.collect())) == brute(rows, 4, 85)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        words = base[:]
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"e{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    out = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85)
    assert Counter(map(tuple, out.collect())) == by_index(rows, 4, 85)


def by_index(rows, k, percent):
    """As brute, with intersections counted by shingle, for many alike texts."""
    import numpy as np

    sets = [shingles(t, k) for _, t in rows]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(1)
    root = np.arange(len(sets))
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    while True:
        least = np.where(linked, root[None], len(sets)).min(1)
        if (least == root).all():
            return Counter((d, len(s), rows[r][0]) for (d, _), s, r in zip(rows, sets, root, strict=True))
        root = least


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 300)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(-(2**62), 2**62, rng.integers(0, 30))]))
        if not len(b):
            continue
        band = nj.band_of(max(len(a), len(b)), 85)
        x, y = nj.bitmap(a, band, 85), nj.bitmap(b, band, 85)
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_long_words_cross_blocks(monkeypatch):
    text = " ".join("x" * (i % 37 + 1) + str(i) for i in range(400))
    whole = nj.shingle_set(text, 4)
    monkeypatch.setattr(nj, "BLOCK_BYTES", 50)
    assert (nj.shingle_set(text, 4) == whole).all() and len(whole) == 397


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (200, 1), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_rows_without_a_set(spark, docs, texts, no_docs):
    kept = nj.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    expected = brute(list(enumerate(t for _, t in texts)), 5, 80)
    assert kept.count() == len({c if c is not None else d for d, _, c in expected})
    assert nj.one_of_each(no_docs).count() == 0
