"""Registered queries against their DuckDB twins, and learned ones against rows that they never saw."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from driftloom.llm.queries import ORACLE, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    theirs = con.execute(ORACLE[name]).fetchall()
    names = [c[0] for c in con.description]
    ours = QUERIES[name](spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)


def test_quality_of_unseen_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, LARGER).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = np.array([r.score for r in rows if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if labels[r.doc_id] == 0])
    assert len(good) > 20 and len(bad) > 5
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_of_unseen_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, LARGER).collect() if r.held_out and lang[r.doc_id] is not None]
    assert len(rows) > 100
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97
