import datetime

import pytest
from pyspark.sql import Window as W, functions as F

from levylens import functions as f


def evaluate(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1,000", None), ("", None), ("NA", None), (" 12 ", 12.0), ("1e5", 100000.0), ("n/a", None),
     ("1d", None), ("2F", None), ("-3.5", -3.5), ("inf", float("inf")), (None, None)],
)
def test_num(spark, text, expected):
    assert evaluate(spark, f.num("x"), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("\tAlbany", "Albany"), ("  Albany ", "Albany "), ("  Erie", "Erie"), ("a b", "a b")],
)
def test_ltrim_ws(spark, text, expected):
    assert evaluate(spark, f.ltrim_ws("x"), text) == expected


@pytest.mark.parametrize(
    ("text", "pattern", "replacement", "expected"),
    [("St a St b", "St ", "St. ", "St. a St b"),
     ("New York City - Bronx", "New York City - ", "", "Bronx"),
     ("2013 - 2014", " .*", "", "2013"),
     ("March - May", " .*", "", "March"),
     ("line\nSt x", "St ", "St. ", "line\nSt. x"),
     ("ab", "b", "$1\\", "a$1\\"),
     ("none", "x|y", "z", "none"),
     (None, "a", "b", None)],
)
def test_replace_first(spark, text, pattern, replacement, expected):
    assert evaluate(spark, f.replace_first("x", pattern, replacement), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ST LAWRENCE", "St Lawrence"), ("MCTD", "Mctd"), ("NY STATE", "Ny State"),
     ("O'NEIL-SMITH", "O'neil-Smith"), ("A/B (CD)", "A/B (Cd)"), (None, None)],
)
def test_title_case(spark, text, expected):
    assert evaluate(spark, f.title_case("x"), text) == expected


def test_membership_and_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    rows = df.select("x", f.is_in("x", ["a"]), f.not_in("x", ["a"])).collect()
    assert [tuple(r) for r in rows] == [
        ("a", True, False), ("b", False, True), (None, False, True),
    ]
    kept = df.where(f.not_in("x", ["a"])).collect()
    assert [r.x for r in kept] == ["b", None]


def test_if_else_na_keeps_unknown_tests_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rows = df.select(f.if_else_na(F.col("x") == 1, F.lit("y"), F.lit("n")).alias("r")).collect()
    assert [r.r for r in rows] == ["y", "n", None]


def test_case_ordered_first_match_wins(spark):
    x = F.col("x")
    label, order = f.case_ordered([(x < 3, "low"), (x < 9, "mid")])
    df = spark.createDataFrame([(1,), (5,), (10,), (None,)], "x int")
    rows = df.select(label, order).collect()
    assert [tuple(r) for r in rows] == [("low", 1), ("mid", 2), (None, None), (None, None)]


def test_missing_includes_nan_only_for_numbers(spark):
    assert evaluate(spark, f.is_missing("x", numeric=True), float("nan"), "double") is True
    assert evaluate(spark, f.is_missing("x"), "NaN") is False
    assert evaluate(spark, f.is_missing("x"), None) is True


def test_sums_and_means(spark):
    df = spark.createDataFrame(
        [("full", 1.0), ("full", 2.0), ("part", 1.0), ("part", None), ("none", None)],
        "k string, x double",
    )
    rows = df.groupBy("k").agg(f.sum0("x"), f.sum_strict("x"), f.mean_strict("x")).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {
        "full": (3.0, 3.0, 1.5), "part": (1.0, None, None), "none": (0.0, None, None),
    }
    w = W.partitionBy("k")
    windowed = df.select("k", f.sum0("x", over=w), f.sum_strict("x", over=w)).distinct().collect()
    assert {r[0]: tuple(r)[1:] for r in windowed} == {
        "full": (3.0, 3.0), "part": (1.0, None), "none": (0.0, None),
    }


def test_ratio_and_log(spark):
    assert evaluate(spark, f.ratio("x", F.lit(0.0)), 1.0, "double") is None
    assert evaluate(spark, f.ratio("x", F.lit(4.0)), 1.0, "double") == 0.25
    assert evaluate(spark, f.log10("x"), 1000.0, "double") == pytest.approx(3.0)
    assert evaluate(spark, f.log10("x"), 0.0, "double") is None


def test_months_and_dates(spark):
    assert evaluate(spark, f.month_no("x"), "March") == 3
    assert evaluate(spark, f.month_no("x"), "Foo") is None
    assert evaluate(spark, f.year_month("x"), "2013/3") == datetime.date(2013, 3, 1)
    assert evaluate(spark, f.year_month("x"), "2013/12") == datetime.date(2013, 12, 1)
    assert evaluate(spark, f.year_month("x"), "2013/NA") is None
    assert evaluate(spark, f.month_label("x"), datetime.date(2013, 3, 1), "date") == "Mar-13"
    assert evaluate(spark, f.date_lit("2019-01-01"), None) == datetime.date(2019, 1, 1)


def test_formats(spark):
    def number(expression, value):
        return evaluate(spark, expression, value, "double")

    assert number(f.rounded_text("x"), 0.125) == "0.12"
    assert number(f.rounded_text("x"), 3.0) == "3.00"
    assert number(f.percent_text("x"), 0.12345) == "12.35%"
    assert number(f.percent_label("x"), 0.149) == "15%"
    assert number(f.comma("x"), 1234567.0) == "1,234,567"
    assert number(f.dollar("x"), 97016.4) == "$97,016"
    assert number(f.unit_label("x", "B"), 2.03e11) == "203.0 B"
    assert number(f.unit_label("x", "T", 0), 1222709.0) == "1,223 T"


def test_paste_writes_missing_parts(spark):
    df = spark.createDataFrame([("2013", None)], "a string, b int")
    assert df.select(f.paste("a", "b", sep="/")).first()[0] == "2013/NA"


def test_missing_numbers_have_no_text(spark):
    from levylens.functions import comma, dollar, percent_label, percent_text, rounded_text, unit_label

    df = spark.createDataFrame([(None,), (float("nan"),), (0.125,)], "x double")
    made = [rounded_text("x"), percent_text("x"), percent_label("x"), comma("x", 1), dollar("x"), unit_label("x", "T")]
    got = [tuple(r) for r in df.select(*made).collect()]
    assert got[0] == got[1] == (None,) * 6
    assert got[2][:3] == ("0.12", "12.50%", "12%")


def test_malformed(spark):
    from levylens.functions import malformed

    cells = ["1", " 2.5 ", "1e3", "n/a", "1,000", "", "  ", "NA", "NaN", None, "1d", "-", "Infinity"]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    got = [r[0] for r in df.select(malformed("x")).collect()]
    assert [c for c, bad in zip(cells, got) if bad] == ["n/a", "1,000", "1d", "-"]
    assert None not in got


def test_fixed_lists():
    """The lists as typed from the published tables, not taken from the code."""
    from levylens import constants as c

    assert sorted(c.DOWNSTATE) == [
        "Bronx", "Dutchess", "Kings", "Nassau", "New York", "Orange", "Putnam", "Queens", "Richmond",
        "Rockland", "Suffolk", "Westchester",
    ]
    assert sorted(c.CITY_COUNTIES) == ["Bronx", "Kings", "New York", "Queens", "Richmond"]
    assert sorted(c.NEIGHBOURS) == ["Connecticut", "Florida", "Massachusetts", "New Jersey", "Pennsylvania"]
    assert sorted(c.LEGACY_STATES) == ["Connecticut", "New Jersey", "New York", "Pennsylvania"]
    assert c.NOT_CONTIGUOUS == ["Alaska", "Hawaii"] and sorted(c.SALES_ROLLUPS) == ["Mctd", "Ny City", "Ny State"]
    assert sorted(c.WAYFAIR_INDUSTRIES) == ["4522", "4541"]
    assert sorted(c.WAYFAIR_JURISDICTIONS) == ["ALBANY", "ERIE", "MONROE", "ONONDAGA", "ORANGE"]
    assert [m[:3] for m in c.MONTHS] == "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    states = """Alabama Alaska Arizona Arkansas California Colorado Connecticut Delaware Florida Georgia Hawaii Idaho
        Illinois Indiana Iowa Kansas Kentucky Louisiana Maine Maryland Massachusetts Michigan Minnesota Mississippi
        Missouri Montana Nebraska Nevada New_Hampshire New_Jersey New_Mexico New_York North_Carolina North_Dakota Ohio
        Oklahoma Oregon Pennsylvania Rhode_Island South_Carolina South_Dakota Tennessee Texas Utah Vermont Virginia
        Washington West_Virginia Wisconsin Wyoming"""
    assert c.STATE_NAMES == [x.replace("_", " ") for x in states.split()]
    assert all(-130 < x < -65 and 24 < y < 50 for _, x, y in c.STATE_CENTERS)
    assert c.V1_NOT_COUNTIES == ["Grand Total, Full-Year Resident", "Residence Unknown ++", "NYS Unclassified +", "All Places"]
    assert c.V2_NOT_COUNTIES == [
        "All New York City", "Other Places- NYS Resident", "All Counties Outside of New York City", "All Places",
    ]
    assert [len(raw) for _, raw in c.INCOME_GROUPS] == [4, 3, 2, 1, 2, 1]
    bounds = [int(x.split(" ")[0].replace(",", "").replace("Under", "0")) for _, raw in c.INCOME_GROUPS for x in raw]
    assert bounds == [0, 5000, 10000, 20000, 30000, 40000, 50000, 60000, 75000, 100000, 200000, 250000, 500000]
    assert c.MISLABELLED_HAMILTON_AGI_K == 802099
