"""Licence notices in documents, by a positional index of the rare words of licence texts."""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices of public licences as (label, wording, phrases that must be there).
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person obtaining a copy",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    ("gpl", "licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the BSD License", ("bsd license",)),
    ("mpl", "subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
)
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Rare words indexed of a template, and the share of a template's that must line up.
TEMPLATE_WORDS, MIN_COVERAGE = 6, 0.6


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.lower()) if w]


VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in template_words(text)})


def lower_words(text: Column) -> Column:
    """Words with A-Z in lower case. The one letter beyond ASCII whose lower case is ASCII is swapped first; other letters
    beyond ASCII may change case, which no licence word can notice."""
    return F.filter(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), NO_WORD), lambda w: w != "")


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    held = docs.select(F.array_intersect(lower_words(F.coalesce(F.col(text_col), F.lit(""))), vocabulary).alias("held"))
    rows = held.select(F.explode_outer("held").alias("word")).groupBy("word").count().collect()  # a row for each licence word at most
    counts, n = {r["word"]: r["count"] for r in rows}, max(docs.count(), 1)
    return {w: log((n + 1) / (counts.get(w, 0) + 1)) for w in VOCABULARY}


def build_index(idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, position) of each template's rarest words, and how many each template has."""
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = template_words(text)
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:TEMPLATE_WORDS]
        sizes.append(len(rare))
        for i in rare:
            postings.setdefault(words[i], []).append((t, i))
    return postings, sizes


def _needed(size: int) -> int:
    return max(2, round(MIN_COVERAGE * size))


def _reachable(held: Column, postings: dict[str, list[tuple[int, int]]], sizes: list[int]) -> Column:
    """The words of held that belong to a template of which held has enough; no other template can count."""
    of = [[w for w, places in postings.items() for t, _ in places if t == at] for at in range(len(sizes))]  # a word for each place
    templates = F.array(*[F.struct(F.lit(_needed(s)).alias("need"), F.array(*map(F.lit, ws)).alias("words")) for s, ws in zip(sizes, of, strict=True)])
    enough = F.filter(templates, lambda t: F.size(F.filter(t["words"], lambda w: F.array_contains(held, w))) >= t["need"])
    return F.array_intersect(held, F.flatten(F.transform(enough, lambda t: t["words"])))


def _stands_at(words: Column, phrase: str, i: Column) -> Column:
    parts = phrase.split(" ")
    test = F.coalesce(F.get(words, i) == parts[0], F.lit(False))
    for k, w in enumerate(parts[1:], 1):
        test = test & F.coalesce(F.get(words, i + k) == w, F.lit(False))
    return test


def _aligned(words: Column, rare: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """template * 2**40 + (place in the file - place in the template) for every posting of the file's rare words."""
    by_word = [F.struct(F.lit(w).alias("word"), F.array(*[F.lit(t * 2**40 - i) for t, i in p]).alias("at")) for w, p in postings.items()]
    index = F.array(*by_word)
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: F.array_contains(rare, x["w"]))
    mine = F.filter(index, lambda p: F.array_contains(rare, p["word"]))

    def codes(few: Column) -> Column:
        return F.flatten(F.transform(places, lambda x: F.transform(F.filter(few, lambda p: p["word"] == x["w"])[0]["at"], lambda a: a + x["i"] + 2**20)))

    return let(mine, codes)


def _templates(codes: Column, words: Column, sizes: list[int]) -> Column:
    """(template, coverage) of templates enough of whose rare words stand in their relative places."""
    zero = F.struct(F.lit(-1).cast("long").alias("code"), F.lit(0).alias("run"), F.array().cast("array<struct<t:int,n:int>>").alias("best"))

    def step(a: Column, c: Column) -> Column:
        run = F.when(a["code"] == c, a["run"] + 1).otherwise(1)
        need = F.get(F.array(*[F.lit(_needed(s)) for s in sizes]), F.shiftright(c, 40).cast("int"))
        more = F.when(run >= need, F.concat(a["best"], F.array(F.struct(F.shiftright(c, 40).cast("int").alias("t"), run.alias("n"))))).otherwise(a["best"])
        kept = F.when(F.size(more) > 64, F.array_distinct(more)).otherwise(more)  # at most templates x words differ
        return F.struct(c.alias("code"), run.alias("run"), kept.alias("best"))

    return F.aggregate(F.sort_array(codes), zero, step, lambda a: F.array_distinct(a["best"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    Base: places where the words of a base phrase stand consecutively (n_base, the smallest and largest start, labels).
    Method: all indexed words in a file are looked up, but for those of templates of which it has too few; a template
    counts if MIN_COVERAGE of its own rarest words stand in their relative places, and its mandatory phrases are in the file.
    labels joins both, distinct, sorted and comma-joined. score is the largest share of a template's rare words that line up, at least
    0.75 with a base label, else 0.
    A null text counts as empty: no words, empty labels, score 0. Ties in rareness go to the earlier word. Null ids and
    repeated rows stay rows of their own. Files are scanned in place; only the counts of licence words are shuffled.
    """
    idf = word_idf(docs, text_col)
    postings, sizes = build_index(idf)
    rarest = F.array(*[F.lit(w) for w in sorted(postings, key=lambda w: (-idf[w], w))])
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), lower_words(text).alias("words"))
    words = F.col("words")
    ends = {p.split(" ")[-1] for p, _ in BASE}
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ends), i)), lambda i: i.isNotNull())
    starts = lambda phrase: F.transform(F.filter(F.transform(places, lambda i: i - (phrase.count(" "))), lambda i: (i >= 0) & _stands_at(words, phrase, i)), lambda i: i.cast("long"))
    any_end = F.arrays_overlap(words, F.array(*map(F.lit, ends)))
    none = F.array().cast("array<long>")
    based = split.select(
        "doc_id", "words", F.array_intersect(rarest, words).alias("held"),
        *[F.when(any_end, starts(p)).otherwise(none).alias(label) for p, label in BASE],
    )
    based = based.withColumn("rare", F.when(F.size("held") >= 2, _reachable(F.col("held"), postings, sizes)).otherwise(F.array().cast("array<string>")))
    codes = F.when(F.size("rare") >= 2, _aligned(words, F.col("rare"), postings)).otherwise(none)
    matched = based.drop("held").select("*", codes.alias("codes")).select("*", F.when(F.size("codes") >= 2, _templates(F.col("codes"), words, sizes)).otherwise(F.array().cast("array<struct<t:int,n:int>>")).alias("hits"))
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    verified = F.filter("hits", lambda h: _phrases_hold(h["t"], padded))
    found = matched.select("*", F.when(F.size("hits") > 0, verified).otherwise(F.col("hits")).alias("good"))
    all_starts = F.concat(*[F.col(label) for _, label in BASE])
    base_labels = F.array_sort(F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull()))
    names, totals = F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.array(*map(F.lit, sizes))
    labels = F.array_sort(F.array_union(base_labels, F.transform("good", lambda h: F.get(names, h["t"]))))
    cover = F.coalesce(F.array_max(F.transform("good", lambda h: h["n"] / F.get(totals, h["t"]))), F.lit(0.0))
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).alias("first_word"), F.array_max(all_starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.least(F.greatest(cover, F.when(F.size(all_starts) > 0, 0.75).otherwise(0.0)), F.lit(1.0)).alias("score"),
    )


def _phrases_hold(template: Column, padded: Column) -> Column:
    case = F.lit(False)
    for t, (_, _, phrases) in enumerate(TEMPLATES):
        for phrase in phrases:
            case = F.when(template == t, F.contains(padded, F.lit(f" {phrase} "))).otherwise(case)
    return case
