"""Hand-computed results of the analyses on small raw tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from levylens.constants import AGI, INCOME_GROUPS, LIABILITY, RETURNS, STATE_CENTERS
from levylens.plans import income, maps, quality, sales, states, views
from levylens.sources import schemas
from levylens.sources.reference import inline, state_centers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def v1(spark, data):
    """(year, state, county, class, returns, agi_k, liability_k)"""
    full = [(y, s, c, k, "1", "2", r, a, t) for y, s, c, k, r, a, t in data]
    return spark.createDataFrame(full, schemas.INCOME_V1)


def v2(spark, data):
    """(year, state, county, residence, status, returns, ny_agi, federal_agi, liability)"""
    return spark.createDataFrame([(*row, "0") for row in data], schemas.INCOME_V2)


@pytest.fixture(scope="module")
def raw_v1(spark):
    ny, total = "New York", "Total"
    return v1(
        spark,
        [
            ("2004", ny, " Albany", total, "100", "5000", "250"),
            ("2004", ny, "New York City - Bronx", total, "200", "8000", "300"),
            ("2004", ny, "New York City - Manhattan", total, "300", "60000", "4000"),
            ("2004", ny, "Kings", total, "n/a", "7000", "350"),
            ("2004", ny, None, total, "1", "10", "1"),
            ("2004", ny, "All Places", total, "999", "9", "9"),
            ("2004", ny, " Albany", "Under 5,000", "5", "5", "5"),
            ("2005", ny, "Hamilton", total, "30", "802099", "40000"),
            ("2005", ny, "Hamilton", total, "10", "900", "30"),
            ("2005", ny, "Hamilton", total, "0", "x", "0"),
            ("2004", "New Jersey", "All", total, "50", "4000", "200"),
        ],
    )


@pytest.fixture(scope="module")
def raw_v2(spark):
    ny, everyone = "New York", "All Returns"
    return v2(
        spark,
        [
            ("2015", ny, "Manhattan", ny, everyone, "10", "100", "100", "9"),
            ("2015", ny, " Manhattan", ny, everyone, "20", "200", "200", "8"),
            ("2015", ny, " Erie", ny, "Taxable", "1", "1", "1", "1"),
            ("2015", ny, "All Places", "All Places", everyone, "30", "300", "300", "17"),
            ("2015", "Ohio", "All", "Ohio", everyone, "4", "40", "44", "3"),
            ("2015", "Ontario", "All", "Ontario", everyone, "4", "40", "44", "3"),
        ],
    )


def test_county_income_v1(raw_v1):
    assert rows(income.county_income_v1(raw_v1)) == sorted(
        [
            (2004, "Albany", 5000000.0, 250000.0, 100.0),
            (2004, "Bronx", 8000000.0, 300000.0, 200.0),
            (2004, "New York", 60000000.0, 4000000.0, 300.0),
            (2004, "Kings", 7000000.0, 350000.0, None),
            (2004, None, 10000.0, 1000.0, 1.0),
            (2005, "Greene", 802099000.0, 40000000.0, 30.0),
            (2005, "Hamilton", 900000.0, 30000.0, 10.0),
            (2005, None, None, 0.0, 0.0),
        ],
        key=str,
    )


def test_county_income_v2_renames_before_trimming(raw_v2):
    assert rows(income.county_income_v2(raw_v2)) == [
        (2015, "Manhattan", 200.0, 8.0, 20.0), (2015, "New York", 100.0, 9.0, 10.0),
    ]


def test_region_per_return(raw_v1):
    out = income.region_per_return(income.county_income_v1(raw_v1))
    got = {tuple(r)[:3]: r.value for r in out.collect()}
    agi, tax = "AGI per returnee", "Tax liability per returnee"
    assert got == {
        (2004, "Downstate", agi): None,
        (2004, "Downstate", tax): None,
        (2004, "Upstate", agi): pytest.approx(49603.960396),
        (2004, "Upstate", tax): pytest.approx(2485.148515),
        (2005, "Upstate", agi): None,
        (2005, "Upstate", tax): pytest.approx(1000750.0),
    }


def test_long_form_has_three_rows_per_county_and_year(raw_v1, raw_v2):
    counties = income.county_income(raw_v1, raw_v2)
    long = income.county_income_long(counties)
    assert long.columns == ["tax_year", "county", "variable", "value"]
    assert long.count() == 3 * counties.count()
    pairs = quality.rows_per_county_year(long)
    assert {r.freq % 3 for r in pairs.collect()} == {0}


def test_extremes_return_the_whole_series(spark):
    data = [(y, c, float(n * 10 + y), 1.0, 1.0) for y in (1, 2) for n, c in enumerate("abcdefg")]
    counties = spark.createDataFrame(
        data + [(2, None, 99.0, 1.0, 1.0), (1, None, 0.0, 1.0, 1.0), (2, "x", None, 1.0, 1.0)],
        f"tax_year int, county string, {AGI} double, {LIABILITY} double, {RETURNS} double",
    )
    for bounded in (True, False):
        top = income.county_extremes(counties, AGI, 2, 2, bounded=bounded)
        assert sorted((r.tax_year, r.county) for r in top.where("county is not null").collect()) == [
            (1, "g"), (2, "g"),
        ]
        assert top.where("county is null").count() == 2
        low = income.county_extremes(counties, AGI, 2, 2, largest=False, bounded=bounded)
        assert {r.county for r in low.collect()} == {"a", "b"} and low.count() == 4
        every = income.top_counties_each_year(counties, 1, bounded=bounded)
        assert every.count() == counties.count()  # all tie on returns


def test_thirteen_classes_fold_into_six_ordered_groups(spark):
    labels = [label for _, raw in INCOME_GROUPS for label in raw]
    assert len(labels) == 13
    ny, total = "New York", "Grand Total, Full-Year Resident"
    data = [("2014", ny, total, label, "1", "100", str(i)) for i, label in enumerate(labels)]
    data += [
        ("2014", ny, total, "Total", "1", "1", "1"), ("2014", ny, " Albany", labels[0], "1", "1", "1"),
        ("2006", ny, total, labels[0], "1", "1", "1"), ("2014", ny, "All", "odd", "1", "10", "5"),
    ]
    rates = income.effective_rate(v1(spark, data))
    got = [(r.income_group, r.income_group_ord) for r in rates.orderBy("income_group_ord").collect()]
    assert got == [(None, None), *((label, i + 1) for i, (label, _) in enumerate(INCOME_GROUPS))]
    first = rates.where("income_group_ord = 1").first()
    assert (first.tax_year, first.variable, first.value) == (2014, "taxRate", 6 / 400)
    view = income.rate_view(rates.where("income_group is not null"), 2014).collect()
    mean = sum(r.value for r in view) / 6
    assert view[0].mean_value == pytest.approx(mean)
    assert view[0].caption == (
        f"The average share for all income\ngroups was {100 * mean:.2f} percent in 2014"
    )


def test_states(raw_v1, raw_v2):
    assert rows(states.states(raw_v1, raw_v2)) == [
        (2004, "New Jersey", 4000000.0, 200000.0, 50.0),
        (2015, "New York", 300.0, 17.0, 30.0),
        (2015, "Ohio", 44.0, 3.0, 4.0),
    ]
    assert rows(states.neighbour_states(raw_v1, raw_v2)) == [
        (2004, "New Jersey", "New Jersey", 4000000.0, 200000.0, 50.0),
        (2015, "Other states", "Ohio", 44.0, 3.0, 4.0),
    ]


def test_state_shares(raw_v1, raw_v2):
    table = states.states(raw_v1, raw_v2)
    for bounded in (True, False):
        both = states.state_share_long(table, ["percLiability", "percAGI"], bounded)
        got = {(r.tax_year, r.state, r.variable): r.value for r in both.collect()}
        assert got[2015, "Ohio", "percLiability"] == pytest.approx(3 / 20)
        assert got[2015, "New York", "percAGI"] == pytest.approx(300 / 344)
        assert got[2004, "New Jersey", "percLiability"] == 1.0
    shares = states.resident_share(table)
    assert rows(shares) == [
        (2004, "Other States", "percLiability", 1.0),
        (2015, "New York", "percLiability", 0.85),
        (2015, "Other States", "percLiability", 0.15),
    ]
    assert states.other_states_mean(shares).first()[0] == pytest.approx(0.575)


def test_trend_and_totals(raw_v1, raw_v2):
    neighbours = states.neighbour_states(raw_v1, raw_v2)
    assert rows(states.neighbour_trend(neighbours)) == [
        (2004, "New Jersey", 200000.0), (2015, "Other states", 3.0),
    ]
    assert states.neighbour_trend(neighbours, ["Ohio"]).count() == 1
    totals = rows(states.state_totals(neighbours, 2015))
    assert totals == [
        ("2015", "Other states", "Ohio", 44.0, 3.0, 4.0), ("Total", "-", "-", 44.0, 3.0, 4.0),
    ]
    for bounded in (True, False):
        assert states.top_states(neighbours, LIABILITY, 2015, bounded=bounded).count() == 1


def test_legacy_groups_are_in_thousands(raw_v1, raw_v2):
    groups = states.legacy_state_groups(raw_v1, raw_v2)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in groups.collect()}
    assert got == {
        (2004, "New York"): (5.0, 5.0, 5.0),
        (2015, "New York"): pytest.approx((60.0, 0.6, 0.034)),
        (2015, "Other states"): pytest.approx((4.0, 0.04, 0.003)),
    }
    assert [r.new for r in states.top_legacy_groups(groups, 2015).collect()] == ["Other states"]


def test_income_definitions(raw_v1, raw_v2):
    assert rows(states.agi_definition_compare(raw_v1, raw_v2)) == [
        (2004, "ny_agi_of_all_returns", 4000000.0),
        (2015, states.FEDERAL_AGI, 44.0),
        (2015, states.NY_AGI, 40.0),
    ]


def test_od_flows(spark):
    assert len(STATE_CENTERS) == 50
    neighbours = spark.createDataFrame(
        [(2019, "x", "Ohio", 1.0, 1234567.0, 1.0), (2019, "x", "Hawaii", 1.0, 10.0, 1.0),
         (2018, "x", "Iowa", 1.0, 10.0, 1.0), (2019, "x", "Utah", 1.0, 0.0, 1.0)],
        f"tax_year int, new string, state string, {AGI} double, {LIABILITY} double, {RETURNS} double",
    )
    out = {r.state: r for r in states.od_flows(neighbours, state_centers(spark)).collect()}
    assert set(out) == {"Ohio", "Utah"}
    assert (out["Ohio"].origin_x, out["Ohio"].destination_x) == (-82.5963, -75.1449)
    assert out["Ohio"].tooltip == "Ohio, 1,234,567" and out["Utah"].width is None


@pytest.fixture(scope="module")
def raw_sales(spark):
    year = "2013 - 2014"
    shop, store, cars = "Electronic Shopping", "Department Stores", "Automobile Dealers"
    return spark.createDataFrame(
        [
            ("ST LAWRENCE", year, "1", "March - May", "4541", shop, "100"),
            ("ST LAWRENCE", year, "2", "June - August", "4541", shop, "50"),
            ("ST LAWRENCE", year, "1", "March - May", "4522", store, "150"),
            ("ST LAWRENCE", year, "1", "March - May", "4411", cars, "700"),
            ("ALBANY", year, "4", "December - February", "4541", shop, None),
        ],
        schemas.SALES,
    )


PERCENT = views.PERCENT


def test_industry_share(raw_sales):
    assert rows(sales.industry_share(raw_sales)) == sorted(
        [
            ("2013", "St. Lawrence", "4541", "Electronic Shopping", "Revenue", 150.0),
            ("2013", "St. Lawrence", "4541", "Electronic Shopping", PERCENT, 15.0),
            ("2013", "St. Lawrence", "4522", "Department Stores", "Revenue", 150.0),
            ("2013", "St. Lawrence", "4522", "Department Stores", PERCENT, 15.0),
            ("2013", "Albany", "4541", "Electronic Shopping", "Revenue", 0.0),
            ("2013", "Albany", "4541", "Electronic Shopping", PERCENT, None),
        ],
        key=str,
    )


def test_spellings_of_a_county_are_added_up(spark, raw_sales):
    lower = raw_sales.withColumn("jurisdiction", F.initcap("jurisdiction"))
    both = sales.county_totals(raw_sales.union(lower), "total")
    got = {(r.county, r.naics_industry_group): r.total for r in both.collect()}
    assert got["St. Lawrence", "4411"] == 1400.0 and len(got) == 4


def test_quarterly_series(raw_sales):
    series = sales.quarterly_series(raw_sales, industry="4541")
    got = [(r.jurisdiction, r.date, r[sales.AMOUNT]) for r in series.collect()]
    assert got == [("ALBANY", datetime.date(2013, 12, 1), None)]
    assert "month" not in series.columns and "sales_tax_year" not in series.columns


def test_top_industries_and_sectors(spark):
    data = [
        ("NY STATE", "2020 - 2021", "1", "March - May", code, f"d{code}", amount)
        for code, amount in (("4411", "50"), ("4522", "30"), ("1111", "20"), ("9911", "5"))
    ] + [("ERIE", "2020 - 2021", "1", "March - May", "4411", "d4411", "1000")]
    table = spark.createDataFrame(data, schemas.SALES)
    top = sales.top_industries(table, "NY STATE", "2020 - 2021", n=2)
    assert top.columns == ["Jurisdiction", "Industry", "Total Revenue"]
    assert [tuple(r)[1:] for r in top.collect()] == [("d4411", "62.50%"), ("d4522", "37.50%")]
    sectors = inline(
        spark, [(44.0, "Retail"), (45.0, "Retail"), (11.0, "Farms")], schemas.SECTORS.names
    )
    kept = sales.top_sectors(table, sectors, "NY STATE", "2020 - 2021", n=2)
    assert [tuple(r)[1:] for r in kept.collect()] == [("Retail", "80.00%"), ("Farms", "20.00%")]
    share = sales.top_sectors(table, sectors, "NY STATE", "2020 - 2021", n=3, pct_of="all")
    assert [tuple(r)[1:] for r in share.collect()] == [
        ("Retail", "76.19%"), ("Farms", "19.05%"), (None, "4.76%"),
    ]
    with pytest.raises(ValueError):
        sales.top_sectors(table, sectors, "NY STATE", "2020 - 2021", pct_of="some")


def test_top_industry_map(spark, raw_sales):
    boundary = spark.createDataFrame(
        [("36089", "St. Lawrence", "g1"), ("36001", "Albany", "g2"), ("36005", "Bronx", "g3"),
         ("36091", "Saratoga", "g4")],
        "GEOID string, county string, geometry string",
    )
    mapped = maps.top_industry_map(boundary, sales.top_industry_by_county(raw_sales))
    got = {r.county: (r.Industry, r.total_rev) for r in mapped.collect()}
    assert got == {
        "St. Lawrence": ("Automobile Dealers", 700.0), "Albany": ("Electronic Shopping", 0.0),
        "Saratoga": (None, None),
    }
    assert [r.county for r in maps.unmatched_regions(mapped).collect()] == ["Saratoga"]
    assert maps.complete_regions(mapped).count() == 2
    assert "GEOID" not in maps.one_year_map(mapped, "2013 - 2014").columns
    for bounded in (True, False):
        quarter = maps.fourth_quarter_map(boundary, raw_sales, bounded)
        assert [(r.county, r.sales_tax_quarter) for r in quarter.collect()] == [("Albany", "4")]
    missing = quality.boundaries_without_sales(boundary, raw_sales)
    assert sorted(r.county for r in missing.collect()) == ["Bronx", "Saratoga"]


def test_q4_industries(spark):
    data = [
        (place, "2013 - 2014", quarter, "x", code, "d", amount)
        for place, quarter, code, amount in (
            ("ERIE", "4", "1111", "5"), ("ALBANY", "4", "1111", "5"), ("ERIE", "4", "2222", "10"),
            ("ERIE", "4", "3333", "1"), ("NY STATE", "4", "3333", "900"), ("ERIE", "1", "3333", "9"),
        )
    ]
    table = spark.createDataFrame(data, schemas.SALES)
    sectors = inline(spark, [(11.0, "Farms")], schemas.SECTORS.names)
    out = sales.top_industries_q4(table, sectors, n=2)
    assert rows(out) == [("2013 - 2014", "1111", 10.0), ("2013 - 2014", "2222", 10.0)]


def test_coverage_checks(raw_v1):
    counties = income.county_income_v1(raw_v1)
    per_year = {r.tax_year: r.freq for r in quality.counties_per_year(counties).collect()}
    assert per_year == {2004: 5, 2005: 3}
    assert quality.county_years(counties).count() == 8
    first = quality.first_row_per_county(counties, 2005)
    assert [r.county for r in first.collect()] == ["Hamilton"]
    assert quality.counties_in_both(counties, 2005, 2004).count() == 0
    missing = quality.counties_missing_in(counties, 2005, 2004)
    assert missing.count() == 5


def test_map_and_classes(spark):
    counties = spark.createDataFrame(
        [(2019, c, x, 1.0, 1.0) for c, x in (("a", 1e6), ("b", 2e6), ("c", 9e8))],
        f"tax_year int, county string, {AGI} double, {LIABILITY} double, {RETURNS} double",
    )
    boundary = spark.createDataFrame(
        [("36001", c, "g") for c in "abcd"], "GEOID string, county string, geometry string"
    )
    for bounded in (True, False):
        mapped = maps.county_map(boundary, counties, bounded=bounded)
        assert mapped.columns[:4] == ["GEOID", "county", "geometry", "tax_year"]
        classes = {r.county: r["class"] for r in maps.county_classes(mapped, 2).collect()}
        assert classes == {"a": 1, "b": 1, "c": 2, "d": None}
        logs = {r.county: r["class"] for r in maps.county_classes(mapped, 3, log=True).collect()}
        assert logs == {"a": 1, "b": 2, "c": 3, "d": None}


def test_views(raw_sales, raw_v1, raw_v2):
    shares = sales.industry_share(raw_sales)
    view = views.industry_view(shares, "Department Stores", ["St. Lawrence"], PERCENT)
    assert [r.value for r in view.collect()] == [15.0]
    seven = views.industry_view(shares, "Department Stores", ["St. Lawrence", *"abcdef"], PERCENT)
    assert [r.value for r in seven.collect()] == [15.0]
    assert [r.county for r in views.county_choices(shares).collect()] == ["Albany", "St. Lawrence"]
    regions = income.region_per_return(income.county_income(raw_v1, raw_v2))
    assert len(views.variable_choices(regions).collect()) == 2
    assert {r.variable for r in views.region_view(regions, "AGI per returnee").collect()} == {
        "AGI per returnee"
    }
