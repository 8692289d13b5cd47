import random
import re
from collections import Counter

from driftloom.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + d for k in range(len(words) - 2) for d in range(3) if windows[tuple(words[k : k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed


def test_statistics_against_brute_force(spark, docs, texts):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = qr.apply_rules(docs, no_labels).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in columns)) for r in rows) == Counter((i, *brute(t)) for i, t in texts)
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_rules_find_planted_junk(spark, no_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [word() + ("###" if bad and i % 2 else "") for _ in range(rng.randint(60, 200))]
        words = [w.upper() for w in words] if bad and not i % 2 else words
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    labels += [(0, 0), (None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in qr.apply_rules(docs, marks).collect()}
    assert sum(kept[i] == (i % 5 != 0) for i in kept) >= 0.98 * len(rows)
    rules = qr.learn_rules(qr.with_statistics(docs), marks)
    assert 1 <= len(rules) <= qr.MAX_RULES and all(1 <= len(r) <= qr.MAX_CONDITIONS for r in rules)
    assert qr.apply_rules(no_docs, marks).count() == 0


def test_no_python_in_the_plan(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = qr.apply_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
