"""Raw income and sales tables derived from order-entry tables.

The published data is not part of this repository, so orders stand in for income (one order is
one return, its price the income, its priority the tax rate) and line items for taxable sales.
The result has the raw tables' shape: text values, total rows, decoys, leading blanks and the
known errors of the published data.

Scale. All source rows go through one aggregate per table, after joins on the customer, supplier
and part keys. The joins are plain equi-joins: no side is assumed small, Spark broadcasts what it
measures to be small and otherwise splits skewed partitions of the sort-merge join, so a customer
with a third of all orders is spread over many tasks. Amounts are whole cents in 64-bit integers
(exact in any order of summation), and what leaves the aggregate is at most years x nations x
classes rows; the text rendering and the total rows work on that.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from levylens.constants import DOWNSTATE, MISLABELLED_HAMILTON_AGI_K
from levylens.sources import files, readers
from levylens.sources.reference import inline

FIRST_V2_YEAR = 1999

# --- fixed values: nation key to place ---------------------------------------------------------
# County names as the income tables spell them without prefix; key 20 is New York without a name.
PLACES = [
    (0, "New York", "Manhattan"), (1, "New York", "Bronx"), (2, "New York", "Kings"),
    (3, "New York", "Nassau"), (4, "New York", "Suffolk"), (5, "New York", "Westchester"),
    (6, "New York", "Dutchess"), (7, "New York", "Albany"), (8, "New York", "Erie"),
    (9, "New York", "Monroe"), (10, "New York", "Onondaga"), (11, "New York", "Orange"),
    (12, "New York", "Hamilton"), (13, "New York", "Greene"), (14, "New York", "St. Lawrence"),
    (15, "New Jersey", None), (16, "New Jersey", None), (17, "Connecticut", None),
    (18, "Connecticut", None), (19, "Pennsylvania", None), (20, "New York", None),
    (21, "Florida", None), (22, "California", None), (23, "Texas", None), (24, "Ontario", None),
]
CITY = ["Manhattan", "Bronx", "Kings"]

# --- fixed values: upper bound of the order price for each income class (income is twice it) ---
INCOME_CLASSES = [
    ("Under 5,000", 2500), ("5,000 - 9,999", 5000), ("10,000 - 19,999", 10000),
    ("20,000 - 29,999", 15000), ("30,000 - 39,999", 20000), ("40,000 - 49,999", 25000),
    ("50,000 - 59,999", 30000), ("60,000 - 74,999", 37500), ("75,000 - 99,999", 50000),
    ("100,000 - 199,999", 100000), ("200,000 - 249,999", 125000), ("250,000 - 499,999", 250000),
    ("500,000 and over", None),
]

# --- fixed values: sales -------------------------------------------------------------------------
SELLING_PERIODS = [
    (1, "March - May"), (2, "June - August"), (3, "September - November"),
    (4, "December - February"),
]
# Two-digit sector of brand 1, 2, ...; 99 is not in the sector table.
BRAND_SECTORS = [
    11, 21, 22, 23, 31, 32, 33, 42, 44, 45, 48, 49, 51, 52, 53, 54, 55, 56, 61, 62, 71, 72, 81,
    92, 99,
]
# Last two digits of the industry group by part type.
TYPE_SUFFIXES = [
    ("ECONOMY", 11), ("LARGE", 21), ("MEDIUM", 22), ("PROMO", 31), ("SMALL", 32), ("STANDARD", 41),
]
NAMED_INDUSTRIES = [
    ("4411", "Automobile Dealers"), ("4522", "Department Stores"),
    ("4541", "Electronic Shopping and Mail-Order Houses"),
]
SECTORS = [
    (11.0, "Agriculture, Forestry, Fishing and Hunting"),
    (21.0, "Mining, Quarrying, and Oil and Gas Extraction"), (22.0, "Utilities"),
    (23.0, "Construction"), (31.0, "Manufacturing"), (32.0, "Manufacturing"),
    (33.0, "Manufacturing"), (42.0, "Wholesale Trade"), (44.0, "Retail Trade"),
    (45.0, "Retail Trade"), (48.0, "Transportation and Warehousing"),
    (49.0, "Transportation and Warehousing"), (51.0, "Information"),
    (52.0, "Finance and Insurance"), (53.0, "Real Estate and Rental and Leasing"),
    (54.0, "Professional, Scientific, and Technical Services"),
    (55.0, "Management of Companies and Enterprises"),
    (56.0, "Administrative and Support and Waste Management and Remediation Services"),
    (61.0, "Educational Services"), (62.0, "Health Care and Social Assistance"),
    (71.0, "Arts, Entertainment, and Recreation"), (72.0, "Accommodation and Food Services"),
    (81.0, "Other Services (except Public Administration)"), (92.0, "Public Administration"),
]


def v1_places() -> list[tuple]:
    """(nation, state, county): the row of the place itself and every total it counts towards."""
    rows = []
    for key, state, county in PLACES:
        rows.append((key, "New York", "All Places"))
        if state == "New York":
            prefix = "New York City - " if county in ("Manhattan", "Bronx") else " "
            rows.append((key, state, county and prefix + county))
            rows.append((key, state, "Grand Total, Full-Year Resident"))
        else:
            rows.append((key, state, "All"))
    rows += [(24, "New York", "Residence Unknown ++"), (20, "New York", "NYS Unclassified +")]
    return rows


def v2_places() -> list[tuple]:
    """(nation, state, county, place_of_residence), as `v1_places`."""
    rows = []
    for key, state, county in PLACES:
        if state == "New York":
            name = county if county == "Manhattan" else county and " " + county
            part = "All New York City" if county in CITY else "All Counties Outside of New York City"
            rows.append((key, state, name, state))
            rows.append((key, state, part, state))
            rows.append((key, state, "All Places", "All Places"))
        else:
            rows.append((key, state, "All", state))
    rows.append((24, "New York", "Other Places- NYS Resident", "New York"))
    return rows


def sales_places() -> list[tuple]:
    """(nation, jurisdiction): counties in upper case and the three roll-ups."""
    rows = []
    for key, state, county in PLACES:
        if state != "New York":
            continue
        name = "New York" if county == "Manhattan" else county
        rows.append((key, name and name.replace(".", "").upper()))
        rows.append((key, "NY STATE"))
        if county in CITY:
            rows.append((key, "NY CITY"))
        if name in DOWNSTATE:
            rows.append((key, "MCTD"))
    return rows


def boundary_names() -> list[tuple]:
    """(nation, GEOID, NAME): New York counties have prefix 36, other places 34."""
    rows = []
    for key, state, county in PLACES:
        prefix = "36" if state == "New York" else "34"
        name = state if prefix == "34" else "New York" if county == "Manhattan" else county
        rows.append((key, f"{prefix}{2 * key + 1:03d}", name))
    return rows


# A county without any data.
EXTRA_BOUNDARY = (24, "36091", "Saratoga")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.table_again(spark, f"{folder}/{name}.parquet")


#: What a row of the larger tables takes in the shuffles here, four numbers of up to sixteen columns.
SHUFFLED_SHARE = 0.4


def shuffled_bytes(spark: SparkSession, folder: str) -> int:
    """About the bytes that the widest shuffle of a derived table moves, from the files' sizes."""
    sizes = [files.size(spark, f"{folder}/{t}.parquet") for t in ("orders", "lineitem")]
    return int(SHUFFLED_SHARE * max(sizes))


def _since(column: str, first: str, last: str) -> Column:
    """first <= column < last, as a range that reaches the scan."""
    day = F.col(column)
    return (day >= F.lit(first).cast("timestamp_ntz")) & (day < F.lit(last).cast("timestamp_ntz"))


def _income_period(years: tuple[int, int] | None, first: int, last: int) -> Column:
    """The days of the wanted years that lie in an era; false, and no scan at all, without any."""
    start, end = max(first, (years or (first, last))[0]), min(last, (years or (first, last))[1])
    if start > end:
        return F.lit(False)
    return _since("o_orderdate", f"{start:04d}-01-01", f"{end + 1:04d}-01-01")


def _money_text(cents: str, factor: str) -> Column:
    """Whole cents times a decimal factor as plain digits."""
    return F.expr(f"STRING(CAST({cents} AS DECIMAL(28,0)) * {factor}BD)")


def _lookup(c: Column, pairs: list[tuple], default: Column) -> Column:
    return F.coalesce(*[F.when(c == key, F.lit(value)) for key, value in pairs], default)


def _income_base(
    spark: SparkSession, folder: str, in_period: Column, by_class: bool
) -> DataFrame:
    """One row per year, nation, tax rate (hundredths) and, if wanted, income class number.

    Orders are shuffled to their customer as four numbers; the class is worked out from the
    amount afterwards, in front of the partial aggregate. Aggregating per customer before the
    join was measured too: slower even when one customer has a third of the orders, since
    hardly any other customer's orders fall together and the join still shuffles them again.
    """
    orders = (
        _table(spark, folder, "orders")
        .where(in_period)
        .selectExpr(
            "o_custkey",
            "YEAR(o_orderdate) AS year",
            "INT(LEFT(o_orderpriority, 1)) AS rate",
            "BIGINT(RINT(o_totalprice * 100)) AS cents",
        )
    )
    customers = _table(spark, folder, "customer").withColumnRenamed("c_nationkey", "nation")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    keys = ["year", "nation", "rate"]
    if by_class:
        steps = [f"INT(cents >= {100 * bound})" for _, bound in INCOME_CLASSES[:-1]]
        joined = joined.withColumn("class", F.expr(" + ".join(["1", *steps])))
        keys.append("class")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("returns"), F.sum("cents").alias("cents")
    )


def _totals() -> list[Column]:
    return [
        F.sum("returns").alias("returns"),
        F.expr("SUM(CAST(cents AS DECIMAL(28,0))) AS cents"),
        F.expr("SUM(CAST(cents AS DECIMAL(28,0)) * rate) AS rate_cents"),
        F.min("nation").alias("first_nation"),
        F.max("year").alias("group_year"),
    ]


def _year_text(years: tuple[int, int] | None) -> Column:
    """The year as text: a constant for a single year. Otherwise an aggregate of its group, so that
    a test of the text is made of the groups and not pushed down to every order, whose years a
    range of days has already picked."""
    if years and years[0] == years[1]:
        return F.lit(str(years[0]))
    return F.col("group_year").cast("string")


def raw_income_v1(
    spark: SparkSession, folder: str, years: tuple[int, int] | None = None
) -> DataFrame:
    """Income by size of income and place, years before FIRST_V2_YEAR; of `years` (first and last)
    only those.

    Known errors: Greene's 1996 total is filed as Hamilton with the published wrong amount,
    St. Lawrence's 1997 returns and Hamilton's 1998 income are not numbers.
    """
    before = _income_period(years, 1, FIRST_V2_YEAR - 1)
    places = inline(spark, v1_places(), ["place", "state", "county"])
    # Class 0 is the total over classes.
    classes = F.explode(F.array(F.col("class"), F.lit(0)))
    summed = (
        _income_base(spark, folder, before, by_class=True)
        .join(places, F.col("nation") == F.col("place"))
        .withColumn("class", classes)
        .groupBy("year", "state", "county", "class")
        .agg(*_totals())
    )
    labels = F.array(F.lit("Total"), *[F.lit(label) for label, _ in INCOME_CLASSES])

    def error(county: str, year: int) -> Column:
        return (F.col("county") == county) & (F.col("year") == year) & (F.col("class") == 0)

    agi = _money_text("cents", "0.00001")
    county = F.when(error(" Greene", 1996), " Hamilton").otherwise(F.col("county"))
    return summed.select(
        _year_text(years).alias("tax_year"),
        "state",
        county.alias("county"),
        F.get(labels, F.col("class")).alias("income_class"),
        F.col("class").cast("string").alias("income_class_sort_order"),
        F.col("first_nation").cast("string").alias("place_of_residence_sort_order"),
        F.when(error(" St. Lawrence", 1997), "n/a")
        .otherwise(F.col("returns").cast("string"))
        .alias("number_of_all_returns"),
        F.when(error(" Greene", 1996), str(MISLABELLED_HAMILTON_AGI_K))
        .when(error(" Hamilton", 1998), "n/a")
        .otherwise(agi)
        .alias("ny_agi_of_all_returns_in_thousands"),
        _money_text("rate_cents", "0.0000001").alias(
            "tax_liability_of_all_returns_in_thousands"
        ),
    )


def raw_income_v2(
    spark: SparkSession, folder: str, years: tuple[int, int] | None = None
) -> DataFrame:
    """Income by place from FIRST_V2_YEAR on, in dollars, for two filer groups; of `years` (first
    and last) only those."""
    since = _income_period(years, FIRST_V2_YEAR, 9998)
    places = inline(spark, v2_places(), ["place", "state", "county", "residence"])
    summed = (
        _income_base(spark, folder, since, by_class=False)
        .join(places, F.col("nation") == F.col("place"))
        .groupBy("year", "state", "county", "residence")
        .agg(*_totals())
    )
    return summed.select(
        _year_text(years).alias("tax_year"),
        "state",
        "county",
        F.col("residence").alias("place_of_residence"),
        F.explode(F.array(F.lit("All Returns"), F.lit("Taxable"))).alias("tax_liability_status"),
        F.col("returns").cast("string").alias("number_of_returns"),
        _money_text("cents", "0.01").alias(
            "new_york_state_amount_of_ny_adjusted_gross_income"
        ),
        _money_text("cents", "0.011").alias("federal_amount_of_ny_adjusted_gross_income"),
        _money_text("rate_cents", "0.0001").alias("tax_liability"),
        F.floor(F.col("returns") / 4)
        .cast("string")
        .alias("number_filing_married_separate_or_widow_widower"),
    )


def _industry() -> Column:
    """Four-digit industry group of a part as a number."""
    sectors = F.array(*[F.lit(s) for s in BRAND_SECTORS])
    brand = F.substring("p_brand", 7, 3).try_cast("int")
    sector = F.coalesce(F.get(sectors, brand - 1), F.lit(99))
    return sector * 100 + _lookup(F.col("p_type"), TYPE_SUFFIXES, F.lit(99))


def raw_sales(
    spark: SparkSession, folder: str, years: tuple[int, int] | None = None
) -> DataFrame:
    """Quarterly taxable sales by jurisdiction and industry group; of the tax years `years` (by the
    year in which the first and the last one start) only those.

    The tax year starts in March. Hamilton's fourth quarters are not numbers.
    """
    new_york = [key for key, state, _ in PLACES if state == "New York"]
    lines = _table(spark, folder, "lineitem")
    if years:
        lines = lines.where(_since("l_shipdate", f"{years[0]:04d}-03-01", f"{years[1] + 1:04d}-03-01"))
    # Price after discount, rounded half up to whole cents.
    lines = lines.selectExpr(
        "l_partkey",
        "l_suppkey",
        # Quarters since March of year 0.
        "(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) - 3) DIV 3 AS quarter",
        "(BIGINT(RINT(l_extendedprice * 100)) * (100 - BIGINT(RINT(l_discount * 100))) + 50)"
        " DIV 100 AS cents",
    )
    suppliers = (
        _table(spark, folder, "supplier")
        .where(F.col("s_nationkey").isin(*new_york))
        .select("s_suppkey", F.col("s_nationkey").alias("nation"))
    )
    parts = _table(spark, folder, "part").select("p_partkey", _industry().alias("industry"))
    base = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("quarter", "nation", "industry")
        .agg(F.sum("cents").alias("cents"))
    )
    places = inline(spark, sales_places(), ["place", "jurisdiction"])
    summed = (
        base.join(places, F.col("nation") == F.col("place"))
        .groupBy("quarter", "jurisdiction", "industry")
        .agg(F.expr("SUM(CAST(cents AS DECIMAL(28,0))) AS cents"))
    )
    year = F.expr("INT(quarter DIV 4)")
    if years and years[0] == years[1]:
        year = F.lit(years[0])
    quarter = F.expr("INT(quarter % 4)")
    naics = F.col("industry").cast("string")
    other = F.concat(F.lit("Industry group "), naics)
    periods = F.array(*[F.lit(text) for _, text in SELLING_PERIODS])
    unreadable = (F.col("jurisdiction") == "HAMILTON") & (quarter == 3)
    return summed.select(
        "jurisdiction",
        F.format_string("%d - %d", year, year + 1).alias("sales_tax_year"),
        (quarter + 1).cast("string").alias("sales_tax_quarter"),
        F.get(periods, quarter).alias("selling_period"),
        naics.alias("naics_industry_group"),
        _lookup(naics, NAMED_INDUSTRIES, other).alias("description"),
        F.when(unreadable, "n/a")
        .otherwise(_money_text("cents", "0.01"))
        .alias("taxable_sales_and_purchases"),
    )


def sectors(spark: SparkSession) -> DataFrame:
    return inline(spark, SECTORS, ["sector", "sector_description"])


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """One boundary per nation that is a place, plus one county without data."""
    names = inline(spark, [*boundary_names(), EXTRA_BOUNDARY], ["place", "GEOID", "NAME"])
    nations = _table(spark, folder, "nation").select("n_nationkey", "n_name")
    return nations.join(names, F.col("n_nationkey") == F.col("place")).select(
        "GEOID",
        "NAME",
        F.concat(F.lit("POLYGON EMPTY -- "), F.col("n_name")).alias("geometry"),
    )
