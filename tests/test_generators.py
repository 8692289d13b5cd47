import pytest
from pyspark.sql import functions as F

from driftloom.sources import generators as gen

SIZES = {"sea": 3, "hyperplane": 5, "rbf": 4, "weight_inversion": 11}


@pytest.mark.parametrize(("name", "features"), SIZES.items())
@pytest.mark.parametrize("width", [1, 50, 500, 5000])
def test_shape_and_widths(spark, name, features, width):
    df = gen.TWO_BLOCKS[name](spark, 100, 100, width=width)
    assert len(df.columns) == features + 2 and df.count() == 200
    assert df.where(" or ".join(f"{c} is null or isnan({c})" for c in df.columns)).count() == 0


@pytest.mark.parametrize("name", sorted(gen.TWO_BLOCKS))
def test_same_seed_same_rows(spark, name):
    a, b = (gen.TWO_BLOCKS[name](spark, 100, 100, seed=42) for _ in range(2))
    assert a.orderBy("seq").collect() == b.repartition(7).orderBy("seq").collect()
    assert a.orderBy("seq").collect() != gen.TWO_BLOCKS[name](spark, 100, 100, seed=43).orderBy("seq").collect()


def test_bad_options(spark):
    with pytest.raises(ValueError):
        gen.weight_inversion(spark, 10, 10, n_features=5, n_drift_features=6)
    with pytest.raises(ValueError):
        gen.hyperplane(spark, 10, 10, n_features=5, n_drift_features=6)
    with pytest.raises(ValueError):
        gen.multi_window(spark, "nothing")


def test_weight_inversion_is_balanced_and_drifts(spark):
    df = gen.weight_inversion(spark, 3000, 3000)
    share = df.agg(F.avg("target")).first()[0]
    assert 0.45 < share < 0.55
    corr = [df.where(c).agg(F.corr("x1", "target")).first()[0] for c in ("seq < 3000", "seq >= 3000")]
    assert corr[0] > 0.15 and corr[1] < -0.15


@pytest.mark.parametrize("name", sorted(gen.MULTI))
def test_multi_window(spark, name):
    df = gen.multi_window(spark, name, 4, 250, "500", 10)
    assert df.count() == 1000 and df.agg(F.count("target")).first()[0] == 1000
    same = gen.multi_window(spark, name, 4, 250, [], 10)
    changed = df.alias("a").join(same.alias("b"), "seq").where("a.target <> b.target").agg(F.min("seq"), F.max("seq")).first()
    assert changed[0] is not None and changed[0] >= 500


def test_no_positions_means_no_drift():
    assert gen.positions_of("") == [] and gen.positions_of("10, 20") == [10, 20] and gen.positions_of([5]) == [5]
