import random
import re
import zlib
from collections import Counter

import pytest

from driftloom.llm.spelling_variants import count_words, group_variants, near_in_list, near_words, one_edit, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, every=199, min_chars=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, factor=5):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    forms = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= factor * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(links[w]), counts.get(forms[w])))
    return sorted(out, key=repr)


def vocabulary(seed, n):
    """Words with few letters, long repeats and many near words."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 9))) for _ in range(n)}
    words |= {"a" * k for k in range(6, 15)} | {"ab" * k for k in range(3, 9)} | {"zzzzzz" + "q" * 300, "zzzzzz" + "q" * 301}
    for w in rng.sample(sorted(words), 30):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :] + "b", w[:i] + "à" + w[i:], w[:i] + "ö" + w[i + 1 :]}
    return {w: rng.choice([5, 6, 30, 31, 150, 800, 5000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("seed, list_words", [(1, 2000), (2, 7), (3, 1)])
def test_as_brute_force(spark, seed, list_words):
    counts = vocabulary(seed, 150)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = group_variants(words, list_words=list_words)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(counts)


def test_words_of_texts(spark, docs, texts):
    found = {r.word: r.n for r in count_words(docs, every=3).collect()}
    assert found == brute_counts(texts, 3) and found
    got = spelling_variants(docs, every=3)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(brute_counts(texts, 3))


def test_letters(spark):
    rows = [(1, "Straße×÷ ÀÉĀbcdefg ﬁﬁﬁﬁﬁﬁ café_olé abcdef1abcdef"), (2, "𝒜bcdefgh ÑANDÚ ÑANDÚES")] * 5
    found = count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.word: r.n for r in found} == brute_counts(rows, None)


def test_one_edit():
    assert one_edit("abcdef", "abcdeg") and one_edit("aabcdef", "abcdef") and one_edit("abcdeff", "abcdef")
    assert not one_edit("abcdef", "abcdef") and not one_edit("abcdefg", "bacdef") and not one_edit("abcdef", "badcef")


def test_count_filter_verifies():
    indexed = [("abcabcab", 1), ("abcabcac", 2)]
    assert list(near_in_list(indexed, [("abcabcabc", 3), ("xxxxxxxx", 4), ("abcabcad", 5)], 3)) == [("abcabcabc", 3, "abcabcab", 1), ("abcabcabc", 3, "abcabcac", 2), ("abcabcad", 5, "abcabcab", 1), ("abcabcad", 5, "abcabcac", 2)]


def test_query_as_brute_force(spark):
    from driftloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, folder).collect()), key=repr)
    assert found == brute(brute_counts(rows)) and any(r[1] for r in found)


def test_empty(spark, no_docs):
    assert spelling_variants(no_docs).collect() == []
    assert near_words(spark.createDataFrame([], "word string, n long")).collect() == []
