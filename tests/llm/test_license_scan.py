import random
import re
from collections import Counter

from driftloom.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


NOTICES = [
    (1, "Some code.\nReleased under the MIT License.", "mit"),
    (2, "Licensed under the Apache License, Version 2.0.", "apache"),
    (3, "This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (4, "prose prose\nLicensed under CC BY-NC 4.0.", "cc-by-nc"),
    (5, "A.\nAll rights reserved.", "proprietary"),
    (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    (7, "MIT License MIT License and the APACHE license, general public  license", "apache,gpl,mit"),
    (8, "the mit licenses of license mit; rights all", ""),
    (9, "Kmit license mıt lIcense MIT LİCENSE", ""),
    (10, None, ""),
    (11, "", ""),
    (12, "license " * 4000 + "mit license", "mit"),
    (13, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
]


def test_notices(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in NOTICES] * 2, "doc_id long, text string, n_words int")
    rows = ls.scan_licenses(docs).collect()
    assert len(rows) == 2 * len(NOTICES)
    expected = {i: (brute(t), labels) for i, t, labels in NOTICES}
    for r in rows:
        base, labels = expected[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base, r.doc_id
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.labels == labels, r.doc_id
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_base_against_brute_force(spark, docs, texts, no_docs):
    rows = ls.scan_licenses(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in texts)
    assert ls.scan_licenses(no_docs).count() == 0


def test_files_with_many_notices(spark):
    rng = random.Random(7)
    groups = [range(len(ls.TEMPLATES))] + [rng.sample(range(len(ls.TEMPLATES)), 5) for _ in range(40)]
    texts = [". ".join(ls.TEMPLATES[t][1] for t in g) for g in groups]
    filler = [" ".join(w for w in ls.VOCABULARY[:: k % 4 + 1]) for k in range(len(texts))]
    docs = spark.createDataFrame([(k, f"{a}\n{t}\n{a}") for k, (t, a) in enumerate(zip(texts, filler, strict=True))] + [(-k, "plain prose") for k in range(1, 100)], "doc_id long, text string")
    for r in ls.scan_licenses(docs).collect():
        expected = {ls.TEMPLATES[t][0] for t in groups[r.doc_id]} if r.doc_id >= 0 else set()
        assert expected <= set(r.labels.split(",")) and bool(expected) == bool(r.labels), r.doc_id
