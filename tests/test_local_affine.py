import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import boundary
from driftloom.operators.local_affine import LocalAffine, affine, classical_places, force_places, stress


def test_a_rigid_motion_is_kept():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(2, 2)))[0]
    controls, points = rng.normal(size=(15, 2)), rng.normal(size=(200, 2)) * 3
    for near in (None, 5):
        assert np.allclose(affine(points, controls, controls @ turn + [4, -1], near), points @ turn + [4, -1], atol=1e-9)
    assert np.allclose(affine(controls, controls, rng.normal(size=(15, 2))[::-1] * 0 + controls[::-1]), controls[::-1])


def test_a_plane_in_space_and_back():
    rng = np.random.default_rng(1)
    plane = np.linalg.qr(rng.normal(size=(6, 6)))[0][:2]
    flat = rng.normal(size=(300, 2)) * [3, 1]
    controls = flat[:25]
    there = affine(flat @ plane, controls @ plane, controls)
    assert np.allclose(there, flat, atol=1e-8)
    assert np.allclose(affine(there, controls, controls @ plane, 10), flat @ plane, atol=1e-7)


def test_force_lowers_the_stress():
    x = np.random.default_rng(2).normal(size=(40, 6))
    assert stress(x, force_places(x)) < stress(x, classical_places(x))
    flat = np.random.default_rng(3).normal(size=(30, 2))
    assert stress(flat, force_places(flat)) < 1e-20


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    t = rng.uniform(0, 3, 600)
    x = np.column_stack([np.cos(t) * 4, np.sin(t) * 4, rng.normal(0, 0.3, 600), t + rng.normal(0, 0.1, 600)])
    return spark.createDataFrame([(i, *map(float, r), int(s > 1.5)) for i, (r, s) in enumerate(zip(x, t, strict=True))], "row_id long, a double, b double, c double, d double, label int")


NAMES = ["a", "b", "c", "d"]


def test_rows_and_nulls(rows):
    fitted = LocalAffine.fit(rows, NAMES)
    assert len(fitted.controls) == 24 and fitted.places.shape == (24, 2)
    more = rows.withColumn("a", F.when(F.col("row_id") == 3, None).otherwise(F.col("a")))
    found = {r.row_id: r for r in fitted.transform(more).collect()}
    assert found[3].u is None and found[3].v is None and all(r.u is not None for i, r in found.items() if i != 3)
    back = fitted.inverse(fitted.transform(rows).select("row_id", "u", "v")).collect()
    given = {r.row_id: np.array([r[c] for c in NAMES]) for r in rows.collect()}
    off = np.mean([np.linalg.norm(np.array([r[c] for c in NAMES]) - given[r.row_id]) for r in back])
    assert off < 0.25 * np.mean([np.linalg.norm(g - np.mean(list(given.values()), 0)) for g in given.values()])
    assert fitted.transform(rows.where("false")).collect() == []


def test_boundary_map_through_it(rows):
    models = [boundary.classifier(rows.withColumn("label", (F.col("d") > cut).cast("int")), NAMES, trees=5, depth=3) for cut in (1.0, 2.0)]
    marked = boundary.disagreement_map(rows, NAMES, *models, size=20, projector=LocalAffine.fit(rows, NAMES))
    cells = marked.select("differ", "d").collect()
    assert len(cells) == 400 and 0 < sum(r.differ for r in cells) < 400
    assert np.mean([0.8 < r.d < 2.2 for r in cells if r.differ]) > 0.9
