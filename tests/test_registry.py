import pytest

from driftloom.functions.encoding import ColumnTransformer
from driftloom.sources import generators, registry


def test_load_get_reload(spark):
    rows = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 1)], "x double, y string, z int")
    found = registry.Registry(spark, "registry_test")
    names = {d.name for d in found.all()}
    assert set(generators.TWO_BLOCKS) | set(generators.NAMED) <= names and found.get("mine") is None
    for d in found.all()[:6]:
        few = d.load().limit(3)
        assert "target" in few.columns and few.count() == 3
    found.save("mine", rows, "z", ["x"])
    assert found.get("mine").load().columns == ["x", "target"] and found.get("mine").kind == "saved"
    other = registry.Registry(spark, "registry_test")
    assert other.get("mine").load().count() == 2
    found.delete("mine")
    assert found.get("mine") is None and other.get("mine") is not None
    other.reload()
    assert other.get("mine") is None
    with pytest.raises(ValueError, match="unknown streams"):
        registry.Registry(spark, "registry_test", {"weather": "x"})


def test_real_streams(spark, tmp_path):
    (tmp_path / "air.arff").write_text(
        "@relation a\n@attribute Airline {UA,'MQ',ZZ}\n@attribute Flight numeric\n@attribute AirportFrom {ATL,SEA}\n@attribute AirportTo {ATL,XXX}\n"
        "@attribute DayOfWeek {1,2}\n@attribute Time numeric\n@attribute Length numeric\n@attribute Delay {0,1}\n@data\nUA,10,ATL,XXX,1,5,6,0\n'MQ',11,SEA,ATL,2,7,8,1\nZZ,12,SEA,ATL,2,7,?,1\n"
    )
    (tmp_path / "sensor.arff").write_text("@relation s\n@attribute rcdminutes numeric\n@attribute temperature numeric\n@attribute class {1,2}\n@data\n3,20.5,2\n")
    (tmp_path / "pakdd.arff").write_text("@relation p\n@attribute AGE numeric\n@attribute class {0.0,1.0}\n@data\n33,1.0\n")
    (tmp_path / "poker.csv").write_text("1,10,1,11,1,13,1,12,1,1,9\n")
    files = {"airline": "air.arff", "sensor": "sensor.arff", "pakdd": "pakdd.arff", "poker": "poker.csv"}
    found = registry.Registry(spark, "registry_test", {k: str(tmp_path / v) for k, v in files.items()})
    air = found.get("airline").load()
    assert air.columns == ["Airline", "Flight", "DayOfWeek", "Time", "Length", "target"]
    assert [tuple(r) for r in air.orderBy("Flight").collect()] == [(2, 10.0, 1, 5.0, 6.0, 0), (1, 11.0, 2, 7.0, 8.0, 1), (0, 12.0, 2, 7.0, None, 1)]
    assert [tuple(r) for r in found.get("sensor").load().collect()] == [(20.5, 2)]
    assert [tuple(r) for r in found.get("pakdd").load().collect()] == [(33.0, 1)]
    assert found.get("poker").load().first().target == 9
    one = spark.createDataFrame([("ATL",), ("SEA",), ("zz",)], "a string").select(registry.airport_group("a").alias("g"))
    assert [r.g for r in one.collect()] == [2, 1, 0]


def test_first_features_and_shuffle(spark):
    rows = spark.range(50).selectExpr("id AS X1", "id * 2.0D AS X2", "1 AS target", "id AS X4")
    assert registry.first_features(rows, 2).columns == ["X1", "X2", "target"] and registry.first_features(rows, 2).count() == 50
    assert registry.first_features(rows, 3).columns == ["X1", "X2", "X3", "target"] and registry.first_features(rows, 3).count() == 0
    a, b, c = (registry.shuffled(r, s).collect() for r, s in ((rows, 1), (rows.repartition(7), 1), (rows, 2)))
    assert a == b != c and sorted(a) == sorted(rows.collect()) != a


def test_variants_and_hard_switches(spark):
    rows = generators.sea_variants(spark, 4003).collect()
    assert len(rows) == 4000
    for k, limit in enumerate((8.0, 9.0, 7.0, 9.5)):
        assert all(r.target == (r.x1 + r.x2 <= limit) for r in rows if k * 1000 <= r.seq < (k + 1) * 1000)
    hard = lambda make, w: make(spark, 300, 300, width=w).orderBy("seq").collect()
    assert hard(generators.sea, 1) == hard(generators.sea, 4) != hard(generators.sea, 40)
    assert hard(generators.hyperplane, 1) == hard(generators.hyperplane, 49) != hard(generators.hyperplane, 50)


def test_transformer_keeps_what_it_was_fitted_on(spark):
    rows = spark.createDataFrame([(1.0, "a", 7), (3.0, "b", 7), (2.0, None, 7)], "x double, c string, n int")
    fitted = ColumnTransformer.fit(rows, ["x", "n"], ["c"])
    new = spark.createDataFrame([(2.0, "b", 9, "k"), (None, "zz", 7, "k"), (1.0, "a", 7, "k")], "x double, c string, n int, other string")
    found = fitted.transform(new)
    assert found.columns == ["x", "n", "other", "c_b"]
    assert [(r.x and round(r.x, 4), r.n, r.c_b) for r in found.collect()] == [(0.0, 2.0, 1), (None, 0.0, 0), (-1.2247, 0.0, 0)]
