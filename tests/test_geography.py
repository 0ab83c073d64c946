import random

import pytest
from pyspark.sql import functions as F

from marktlens.operators import joins
from marktlens.plans import geography
from marktlens.sources import versions

SCHEMA = "pos int, record int, land int, rb int, kreis int, vb int, gem int, name string, area_km2 double, pop_total long, plz string, lon double, lat double"
ROWS = [
    (0, 10, 1, None, None, None, None, "Nordland", 1.0, 5, None, None, None),
    (1, 10, 1, None, None, None, None, "Second", 1.0, 5, None, None, None),
    (2, 40, 1, 0, 2, None, None, "Kreis A", 9.0, 9, None, None, None),
    (3, 50, 1, 0, 2, 7, None, "Amt", 9.0, 9, None, None, None),
    (4, 60, 1, 0, 2, 7, 1, None, None, 10, "1234", 9.0, 50.0),
    (5, 60, 1, 0, 2, 7, 1, "Dorf", 2.5, 99, "99", None, None),
    (6, 60, 1, 0, 2, 0, 2, "Stadt", 4.0, None, None, 10.0, 50.0),
    (7, 60, 2, 3, 5, 1, 1, "Fern", None, None, "12345", None, None),
    (8, 60, 2, 3, 5, 1, None, "no key", 1.0, 1, None, 1.0, 1.0),
    (9, 10, 3, None, None, None, None, "Leer", 6.0, 7, None, None, None),
]


def register(spark, rows=ROWS):
    more = ["pop_male", "pop_female", "pop_density", "urban_code", "urban_name", "travel_code", "travel_name"]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(None).cast("string").alias(c) for c in more])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_names_fall_back_and_sums_go_up(spark):
    points = spark.createDataFrame([("00001", 50.0, 9.1), ("00001", 50.0, 9.9), ("00002", 50.0, 9.2), ("00003", None, 1.0)], "plz string, lat double, lon double")
    made = geography.build(register(spark), points)
    assert rows_of(made["cities"], "id", "name", "state_name", "region_name", "district_name", "subdistrict_name", "plz_list") == [
        (1_002_0000_002, "Stadt", "Nordland", "RB 0", "Kreis A", None, ["00001"]), (1_002_0007_001, "Dorf", "Nordland", "RB 0", "Kreis A", "Amt", ["00001", "00002"]), (2_305_0001_001, "Fern", "Land 2", "Fern", "Kreis 5", "VB 1", ["12345"]),
    ]
    assert rows_of(made["states"], "land", "name", "area_km2", "pop_total") == [(1, "Nordland", 6.5, 10), (3, "Leer", 6.0, 7)]
    assert rows_of(made["regions"], "land", "rb", "name", "area_km2", "pop_total") == [(2, 3, "Fern", None, None)]  # sums replace what was there, null ones too
    assert rows_of(made["districts"], "kreis", "area_km2", "pop_total") == [(2, 6.5, 10)]
    assert rows_of(made["subdistricts"], "vb", "area_km2", "pop_total") == [(7, 2.5, 10)]


def test_empty_register(spark):
    assert all(df.count() == 0 for df in geography.build(register(spark, [])).values())


def test_texts_become_numbers(spark):
    rows = spark.createDataFrame([("Satzart", "Land", "x"), (" 60 ", "1.0", "a"), ("60", "?", "b")], "record string, land string, name string")
    assert rows_of(geography.typed(rows), "record", "land", "name") == [(60, 1, "a"), (60, None, "b")]


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_in_uneven_country(spark, seed):
    r = random.Random(seed)
    places = [(i, 50 + r.gauss(0, 0.001), 9 + r.gauss(0, 0.001)) for i in range(150)] + [(1000 + i, r.uniform(-80, 80), r.uniform(-170, 170)) for i in range(20)] + [(2000, 50.0, 9.0), (1999, 50.0, 9.0), (3000, None, 1.0)]
    points = [(i, 50 + r.gauss(0, 0.002), 9 + r.gauss(0, 0.002)) for i in range(80)] + [(500 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [(900, None, None)]
    a, b = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (points, places))
    want = {p: min(((y - v) ** 2 + (x - w) ** 2, q) for q, y, x in places if y is not None)[1] for p, v, w in points if v is not None}
    assert {x.point_id: x.place_id for x in joins.nearest(a, b).collect()} == want
    assert joins.cell_width(b) < 0.002
    assert joins.nearest(a, b.filter("false")).count() == 0


def test_versions_change_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        versions.Version(spark, root)
    a = spark.range(3)
    first = versions.reload(spark, root, {"x": a, "y": a})
    broken = a.withColumn("id", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        versions.reload(spark, root, {"x": spark.range(9), "y": broken})
    held = versions.Version(spark, root)
    assert held.version == first.version == 1 and held.table("x").count() == 3
    second = versions.reload(spark, root, {"x": held.table("x").filter("id > 0"), "y": a})  # reads what it replaces
    assert second.version == 2 and second.table("x").count() == 2 and held.table("x").count() == 3
    with pytest.raises(LookupError):
        second.table("z")


def test_of_two_writers_one_counts(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "b", ["x"])], versions.LEDGER).write.parquet(f"{root}/ledger")
    spark.createDataFrame([(1, "a", ["x"])], versions.LEDGER).write.mode("append").parquet(f"{root}/ledger")
    assert [r.folder for r in versions.ledger(spark, root).collect()] == ["a"]
