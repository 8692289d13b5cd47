import random
import re

from driftloom.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        w = WORD.findall(lower(item))
        n = min(window, len(w))
        if not n or item_id is None:
            continue
        for i in range(len(w) - n + 1):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def make_items(texts):
    rng = random.Random(3)
    long = [t for _, t in texts if t and 60 < len(t.split()) < 200]
    items = [(i, " ".join(rng.choice(long).split()[5:30])) for i in range(4)]
    return items + [(10, "one TWO"), (11, ""), (12, None), (None, "one"), (13, "same line here same line here same line here same line"), (13, "same line here same line here same line here same line"), (9, "日本")]


def test_against_brute_force(spark, docs, texts):
    items = make_items(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_bytes in (10**6, 120):
        rows = dc.with_contamination(docs, bench, "found", 10, max_bytes=max_bytes).select("doc_id", "text", "found.*").collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r.n_words, r.n_hit, list(r["items"])) == brute(r.text, items), r.doc_id
            assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_documents_go_and_columns_stay(spark, docs, texts):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    gone = {t for _, t in texts} - {r.text for r in kept.collect()}
    assert gone == {"one two", "ONE Two"}


def test_empty_tables(spark, docs, no_docs, texts):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, nothing).count() == len(texts)
    assert dc.decontaminate(no_docs, nothing).count() == 0


def test_clashing_columns_stay(spark):
    from driftloom.llm import language_id, ngram_join, secrets

    docs = spark.createDataFrame([(1, "some plain words here", "en", 21, "a", "b", "c", 7)], "doc_id long, text string, lang string, n_chars long, _CONTAMINATION string, _language string, _clean string, _ROW int")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert dc.decontaminate(docs, bench).collect() == docs.collect()
    assert secrets.redact_secrets(docs).collect() == docs.collect()
    assert ngram_join.one_of_each(docs).collect() == docs.collect()
    assert language_id.keep_spoken(docs, 0.0).columns == docs.columns


def test_colliding_hashes_are_verified(monkeypatch):
    import numpy as np

    monkeypatch.setattr(dc, "window_hashes", lambda words, size: np.zeros(len(words) - size + 1, np.uint64))
    index = dc.Index.of([(1, "one two"), (2, "two three")], 10)
    n, hit, found = index.scan("one two three two one")
    assert (n, hit.tolist(), found) == (5, [True, True, True, False, False], {"1", "2"})


def test_long_items_and_equal_words_take_linear_time():
    import time

    varied = " ".join(f"w{i % 70_001}" for i in range(100_000))
    for text in (varied, "same " * 100_000):
        began = time.time()
        index = dc.Index.of([(1, text), (2, text), (3, "other words")], 10)
        n, hit, found = index.scan(text)
        assert (n, hit.all(), found) == (100_000, True, {"1", "2"}) and time.time() - began < 5
