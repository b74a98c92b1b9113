"""Free-typed values mapped to a reference list."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import canonical

CITIES = [(1, "Mount Xanovton", "Tirania"), (2, "Ophövez", "Kelloria"), (3, "Old Hesterton", "Zarkand"), (4, "Old Hestertun", "Pavonia"), (5, "Kormikov-sur-Selle", "Sundreach"), (6, "Port Nastampo City", "Tolmark"), (7, "Urmacz", "Kelloria"), (8, "Brackilune Heights", "Kelloria"), (9, "Saint Emmuua", "Halvetia")]
CASES = {
    "ophovez": 2, "OPHÖVEZ (HWR)": 2, "OphÃ¶vez": 2, "Ophöv3z": 2, "Ophvöez": 2, "Ophövez, Kelloria": 2, "Ophövez / Kelloria": 2, "City of Ophövez": 2, "Ophovez City Desk": 2, "Mt. Xanovton": 1, "Xanovton, Mount": 1,
    "Mount   Xanovtonn": 1, "OLD HESTERTUN": 4, "old hesterton*": 3, "Kormikov sur Selle": 5, "kormikov-sue-selle Sundreach": 5, "Pt. Nastampo City": 6, "Urmazc": 7, "Brackilune Hts.": 8, "S:t Emmuua": 9, "Saint Emmuua": 9,
    "Kelloria": -1, "N/A": -1, "various cities": -1, "Klomiglu": -1, "": -1, "   ": -1, "---": -1, "Mount Zafote": -1, "x" * 20_000: -1, "日本": -1,
}


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(CITIES, "city_id int, city string, country string")


def test_cases(spark, cities):
    df = spark.createDataFrame([(v,) for v in CASES] * 2 + [(None,)], "city string")
    got = canonical.map_values(df, "city", cities, "city_id", "city", "country")
    assert got.schema["city_id"].dataType.simpleString() == "int"
    assert {r["city"][:99]: r["city_id"] for r in got.collect()} == {k[:99]: v for k, v in CASES.items()}


def test_column_keeps_rows_and_clashing_names(spark, cities):
    df = spark.createDataFrame([(1, "ophovez", 77), (1, "ophovez", 77), (2, None, 78)], "rec_id int, city string, city_id int")
    got = canonical.map_column(df, "city", cities, "city_id", "city", "country")
    assert got.columns == ["rec_id", "city", "city_id", "city_id_"]
    assert sorted((r["rec_id"], r["city_id"], r["city_id_"] or 0) for r in got.collect()) == [(1, 77, 2), (1, 77, 2), (2, 78, 0)]
    assert canonical.map_column(df.where("false"), "city", cities, "city_id", "city").count() == 0
    odd = canonical.map_column(df.selectExpr("city", "rec_id as _v", "rec_id as _id"), "city", cities, "city_id", "city")
    assert odd.columns == ["city", "_v", "_id", "city_id"] and odd.where("city_id = 2").count() == 2
    assert canonical.map_column(df, "city", cities.where("false"), "city_id", "city").where("city_id_ >= 0").count() == 0


def test_equally_close_entries_are_ambiguous(spark):
    ref = spark.createDataFrame([(1, "South Drelaz"), (2, "South Dreloz")], "i int, n string")
    got = canonical.map_values(spark.createDataFrame([("South Drelz",)], "v string"), "v", ref, "i", "n")
    assert got.first()["i"] == -1


def test_random_slips_are_found(spark, cities):
    r, rows = random.Random(5), []
    for i, c, _ in CITIES:
        if i in (3, 4):
            continue
        for _ in range(20):
            k = r.randrange(1, len(c) - 1)
            rows.append((c[:k] + r.choice(["", "q", c[k] * 2]) + c[k + 1 :], i))
    df = spark.createDataFrame(rows, "v string, want int").distinct()
    got = canonical.map_column(df, "v", cities, "city_id", "city", "country")
    assert got.where(F.col("want") == F.col("city_id")).count() >= 0.97 * df.count()
