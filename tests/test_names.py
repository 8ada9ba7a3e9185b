"""Street and plat names against known cases."""

import pytest
from pyspark.sql import functions as F

from platlark.functions import names as N, platnames as P


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_street_parts_and_keys(spark):
    rows = [
        ("North Alger Street", ("North", "Alger", "Street"), "alger", "NS"),
        ("Street", ("", "Street", ""), "street", ""),
        ("West  Smith & Sons  Ave.", ("West", "Smith & Sons", "Ave."), "smith and sons", "EW"),
        ("NE Café Road", ("NE", "Café", "Road"), "caf", ""),
        ("", ("", "", ""), "", ""),
        (None, ("", "", ""), "", ""),
        ("North", ("", "North", ""), "north", ""),
        ("Rodeo Street/Lane", ("", "Rodeo Street/Lane", ""), "rodeo streetlane", ""),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, x string")
    x = F.col("x")
    got = df.select("i", N.parts(x).alias("p"), N.key(x).alias("k"), N.axis(x).alias("a")).orderBy("i").collect()
    assert [(tuple(r.p), r.k, r.a) for r in got] == [r[1:] for r in rows]


@pytest.mark.parametrize(("x", "digits", "want"), [(2.675, 2, 2.67), (0.0005, 3, 0.001), (0.5, 0, 0.0), (1.5, 0, 2.0), (0.1235, 3, 0.123)])
def test_rounding_follows_the_exact_value(spark, x, digits, want):
    got = spark.range(1).select(N.round_half_even(F.lit(x), digits).alias("y")).first()["y"]
    assert got == round(x, digits) == want


def test_eras_and_themes(spark):
    years = [None, 0, 1900, 1915, 1940, 1965, 2020]
    got = [r.w for r in spark.createDataFrame([(i, y) for i, y in enumerate(years)], "i int, y int").orderBy("i").select(N.era_weight(F.col("y")).alias("w")).collect()]
    assert got == pytest.approx([0.15, 0.15, 0.15, 0.15, 0.575, 1.0, 1.0])
    assert one(spark, "Bird species, berries and no glass", N.theme_words) == ["bird", "spec", "berr", "glas"]
    assert one(spark, " N/A ", N.themed) is False
    assert one(spark, "Phase 10b", N.natural_key) == ["phase ", "0" * 16 + "10", "b"]


BASES = [
    ("SUTTERS MILL SUB NO 01", "SUTTERS MILL", ["1"]),
    ("HIGHLANDS HACKBERRY NO 01A", "HIGHLANDS HACKBERRY", ["1", "A"]),
    ("CAMELBACK 02 SUB PHASE 01", "CAMELBACK", ["1"]),
    ("B BAR B ACRES UNIT NO 01", "B BAR B ACRES", ["1"]),
    ("A T SORENSEN SUB UNIT NO 02", "A T SORENSEN", ["2"]),
    ("PARKCENTER POINTE 01A SUB", "PARKCENTER POINTE", []),
    ("CONCEPT 500 SUB", "CONCEPT 500", []),
    ("PINE 43 SUB NO 01", "PINE 43", ["1"]),
    ("EDSONS SUB LOT 18 AMD", "EDSONS LOT 18", []),
    ("CLOVERDALE RIDGE ESTATES NO 02 BLOCK 1", "CLOVERDALE RIDGE ESTATES BLOCK 1", ["2"]),
    ("LANCASTER TERRACE SUB UNIT NO 01 AND 02 AMD", "LANCASTER TERRACE", ["1"]),
    ("EAST SIDE ADD TO BOISE", "EAST SIDE", []),
    ("AURORA SKY CONDO PROJ AMD NO 01", "AURORA SKY CONDO", []),
    ("CONDO AT HIDDEN SPRINGS THE", "THE CONDO AT HIDDEN SPRINGS", []),
    ("COUNTRY CLUB THE SUB NO 01", "THE COUNTRY CLUB", ["1"]),
    ("MCCARTYS 02ND ADD TO BOISE", "MCCARTYS 02ND", []),
    ("HIDDEN SPRINGS SUB 03RD ADD", "HIDDEN SPRINGS 03RD", []),
    ("DUNDEE 03RD SUB AMD NO 03", "DUNDEE 03RD", []),
    ("", "", []),
    (None, "", []),
]


def test_plat_bases_and_levels(spark):
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BASES)], "i int, name string")
    got = P.parse(df, "name").select("i", P.base_of_parts().alias("base"), "levels").orderBy("i").collect()
    assert [(r.base, r.levels) for r in got] == [b[1:] for b in BASES]


LABELS = [
    ("HIGHLANDS HACKBERRY NO 01A", False, True, "Highlands Hackberry, Phase 1.A"),
    ("RANDALL ACRES SUB NO 03", False, True, "Randall Acres, Phase 3"),
    ("RANDALL ACRES SUB NO 03", True, True, "Randall Acres #3"),
    ("SUTTERS MILL SUB NO 03", False, False, "Sutters Mill"),
    ("EAST SIDE ADD TO BOISE AMD", False, True, "East Side Addition to Boise"),
    ("LUCY IN THE SKY SUB", False, True, "Lucy in the Sky"),
    ("A T SORENSEN SUB", False, True, "A. T. Sorensen"),
    ("B BAR B ACRES SUB", False, True, "B Bar B Acres"),
    ("COUNTRY CLUB THE SUB", False, True, "The Country Club"),
    ("MCCARTYS 02ND ADD TO BOISE", False, True, "McCarty's 2nd Addition to Boise"),
    ("SCOTTS SUB", False, True, "Scott's Subdivision"),
    ("DUNDEE 03RD SUB", False, True, "Dundee 3rd"),
    ("BLASERS 01ST SUB", False, True, "Blaser #1"),
    ("BLASER SUB NO 03", False, True, "Blaser #3"),
    ("DE MEYER ESTATES SUB NO 03 THE REDWOODS", False, True, "De Meyer Estates, Phase 3 — The Redwoods"),
]


def test_plat_labels(spark):
    df = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(LABELS)], "i int, name string, sc boolean, de boolean")
    got = P.display_name(df, "name", "label", F.col("sc"), F.col("de")).orderBy("i").collect()
    assert [r.label for r in got] == [row[3] for row in LABELS]
