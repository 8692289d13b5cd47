import hashlib
import re
from collections import defaultdict

import pytest

from driftloom.llm.exact_dedup import drop_copies, mark_copies

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0, doc_id))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        kept = [False] * len(members)
        kept[members.index(best)] = True
        out += [(m[3], best[3], len(members), k, hashlib.sha256(key.encode()).hexdigest()) for m, k in zip(members, kept, strict=True)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("parts, bits", [(1, 5), (7, 1), (40, 2)])
def test_as_brute_force(spark, docs, texts, parts, bits):
    spaced = [(900 + i, t.replace(" ", " \n" * (1 + i % 3)) if t else t) for i, (_, t) in enumerate(texts[:80])]
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(spaced, "doc_id long, text string"))
    found = mark_copies(more.repartition(parts), "c", ["doc_id"], bits=bits).select("doc_id", "c.*").collect()
    assert order(found) == order(brute(texts + spaced))


def test_no_break_spaces_differ_and_one_row_is_kept(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a\tb\x0b"), (None, "a  b "), (3, "a\tb\x0b"), (4, "\x1fab"), (5, None), (6, "\r\n\f")]
    found = mark_copies(spark.createDataFrame(rows, "doc_id long, text string"), "c").select("doc_id", "c.*").collect()
    assert order(found) == order(brute(rows))
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_one_hot_text(spark):
    """A third of all rows are one text; no round sees more of its rows than it has runs."""
    rows = spark.range(0, 30_000, 1, 16).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot text', concat('t ', id)) AS text", "'x' AS digest", "1 AS size", "2 AS _copy")
    kept = drop_copies(rows)
    assert kept.columns == rows.columns
    assert kept.count() == 20_001 and kept.where("text = 'hot text'").first().doc_id == 0


def test_empty(spark, no_docs):
    assert mark_copies(no_docs, "c").collect() == [] and drop_copies(no_docs).columns == no_docs.columns
