import duckdb
import numpy as np

from driftloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_median_over_the_whole_stream(spark):
    values = np.array([v for (v,) in duckdb.sql(f"SELECT value FROM '{SF_DIR}/events.parquet' ORDER BY ts, event_id").fetchall()])
    assert len(values) > 5000
    padded = np.pad(values, 2, mode="edge")
    expected = np.median([padded[k : k + len(values)] for k in range(5)], axis=0)
    got = {r.seq: r.smooth for r in QUERIES["median_filtered_stream"](spark, SF_DIR).collect()}
    assert got.keys() == set(range(len(values)))
    assert np.allclose([got[k] for k in range(len(values))], expected, atol=1e-6)


def test_distance_between_halves_of_all_embeddings(spark):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF_DIR}/embeddings.parquet'").fetchall()
    expected = {}
    for label in {r[1] for r in rows}:
        a, b = (np.array([r[2] for r in rows if r[1] == label and (r[0] % 2 == 0) == even], float).reshape(-1, 64) for even in (True, False))
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        expected[label] = (0 if not d.size else d.min(1).mean() if len(a) <= len(b) else d.min(0).mean()) + 2 * abs(len(a) - len(b))
    got = {r["class"]: r.distance for r in QUERIES["minimal_distance_halves"](spark, SF_DIR).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-5 for k in got)
