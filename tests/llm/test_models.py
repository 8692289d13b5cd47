import random
import zlib

import numpy as np

from driftloom.llm import language_id as li
from driftloom.llm import quality_classifier as qc


def held(i, modulus, left):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == left


LANGUAGES = {"aa": "the and of thing ing hand", "bb": "der die und ung keit schen", "cc": "que los ción ado para mente"}


def make_documents(n=360):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = sorted(LANGUAGES)[i % 3]
        words = [rng.choice(LANGUAGES[lang].split()) + rng.choice(["", "", rng.choice(LANGUAGES[lang].split())]) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_gradients_match_differences():
    net = li.ByteNet.fresh(["a", "b"], 0)
    rng = np.random.default_rng(0)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, y = rng.integers(97, 105, (6, 20)).astype(np.uint8), rng.integers(0, 2, 6)
    _, grads = net.step(x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.params[name][at]
        losses = []
        for e in (1e-5, -1e-5):
            net.params[name][at] = old + e
            losses.append(net.step(x, y)[0])
        net.params[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-4


def test_tables_give_the_responses():
    net = li.ByteNet.fresh(["a", "b", "c"], 1)
    x = np.random.default_rng(1).integers(0, 256, (4, li.WINDOW)).astype(np.uint8)
    direct = net.pooled(x)[0] @ net.params["out"] + net.params["bias"]
    assert np.allclose(net.logits(x, net.tables()), direct, atol=1e-4)


def test_languages_on_held_out_rows(spark):
    rows = make_documents()
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !!! ###", "bb"), (None, "der die und", "bb"), (1003, rows[0][1] * 200, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    net = li.train(docs)
    assert net.languages == sorted(LANGUAGES)
    out = li.with_language(docs, net, "found").withColumn("held", li.held_out()).collect()
    tests = [r for r in out if r.held and r.doc_id < 1000]
    assert len(tests) > 50 and sum(r.found.lang_pred == r.lang for r in tests) >= 0.95 * len(tests)
    assert all(r.held == held(r.doc_id, 4, 2) for r in out)
    by = {r.doc_id: r.found for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "aa"
    kept = li.keep_spoken(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})


def test_nothing_to_learn_from(spark, no_docs):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.f.lang_pred for r in li.with_language(docs, li.train(docs), "f").collect()] == ["und"]
    assert li.with_language(no_docs, li.train(no_docs), "f").count() == 0


def test_quality_on_held_out_rows(spark, no_docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        rows.append((i, " ".join(w + "###" for w in words) if bad and i % 2 else " ".join(words[:2] * 40) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:600], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels}
    scorer = qc.train(docs, marks)
    out = qc.with_quality(docs, scorer, "score").withColumn("held", qc.held_out()).collect()
    assert all(0 <= r.score <= 1 for r in out) and all(r.held == held(r.doc_id, 3, 1) for r in out)
    tests = [(r.score >= 0.5, truth[r.doc_id] == 1) for r in out if r.held and r.doc_id in truth]
    assert len(tests) > 200 and sum(a == b for a, b in tests) >= 0.95 * len(tests)
    positives_only = qc.train(docs, marks.where("quality = 1"))
    again = qc.with_quality(docs, positives_only, "score").collect()
    tests = [(r.score, truth[r.doc_id]) for r in again if r.doc_id in truth]
    good, poor = ([s for s, q in tests if q == k] for k in (1, 0))
    assert np.mean(good) > np.mean(poor) + 0.3
    assert qc.train(docs, marks.where("quality = 0")) is None
    assert {r.score for r in qc.with_quality(docs, None, "score").collect()} == {0.5}
    assert qc.with_quality(no_docs, scorer, "score").count() == 0
