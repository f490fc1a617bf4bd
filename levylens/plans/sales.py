"""Taxable sales and purchases by jurisdiction and industry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from levylens.constants import SALES_ROLLUPS, WAYFAIR_INDUSTRIES, WAYFAIR_JURISDICTIONS
from levylens.functions import (
    month_no, not_in, num, percent_text, replace_first, sum0, title_case, year_month,
)
from levylens.operators import (
    column_percent, distinct_rows, frequency, merge_left, mutate, pivot_longer, share, slice_head, slice_max,
    unite,
)

AMOUNT = "taxable_sales_and_purchases"
INDUSTRY = ["naics_industry_group", "description"]


def _sector() -> Column:
    return num(F.substring("naics_industry_group", 1, 2))


def county_names(df: DataFrame) -> DataFrame:
    """Upper-case jurisdictions as county names."""
    named = mutate(
        df,
        ("jurisdiction", title_case("jurisdiction")),
        ("jurisdiction", replace_first("jurisdiction", "St ", "St. ")),
    )
    return named.withColumnRenamed("jurisdiction", "county")


def clean_counties(sales: DataFrame) -> DataFrame:
    """Sales rows with county names and amounts as numbers."""
    return county_names(sales.withColumn(AMOUNT, num(AMOUNT)))


def named_totals(sales: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Sales by tax year, jurisdiction and `keys`, with jurisdictions then renamed to counties.

    Names are cleaned once per group of equally spelled rows, not once per row: the text rules
    cost far more than the sum. Two spellings of one county stay apart until summed again.
    """
    groups = sales.groupBy("sales_tax_year", "jurisdiction", *keys)
    return county_names(groups.agg(sum0(num(AMOUNT)).alias(name)))


def county_totals(sales: DataFrame, name: str, first_year_only: bool = False) -> DataFrame:
    """Sales by tax year, county and industry, hash-partitioned by year and county.

    What is shuffled for the second sum is already aggregated, one row per industry, year and
    spelling of a county, and its partitioning also serves a window per county and year.
    """
    totals = named_totals(sales, name, INDUSTRY)
    if first_year_only:
        totals = totals.withColumn("sales_tax_year", replace_first("sales_tax_year", " .*", ""))
    place = ["sales_tax_year", "county"]
    return totals.repartition(*place).groupBy(*place, *INDUSTRY).agg(sum0(name).alias(name))


def industry_totals(
    sales: DataFrame, jurisdiction: str, year: str, industry: str | None = None
) -> DataFrame:
    """Yearly sales per industry of one jurisdiction.

    The conditions concern grouping keys, so the optimizer applies them in the scan.
    """
    totals = (
        sales.withColumn(AMOUNT, num(AMOUNT))
        .groupBy("sales_tax_year", "jurisdiction", *INDUSTRY)
        .agg(sum0(AMOUNT).alias("total_rev"))
        .where((F.col("jurisdiction") == jurisdiction) & (F.col("sales_tax_year") == year))
    )
    return totals if industry is None else totals.where(F.col(INDUSTRY[0]) == industry)


def top_industries(sales: DataFrame, jurisdiction: str, year: str, n: int = 10) -> DataFrame:
    """The largest industries with their percentage of the listed ones' sales."""
    totals = industry_totals(sales, jurisdiction, year)
    return _ranked(slice_max(totals, "total_rev", n, bounded=True), "description", "Industry")


def _ranked(totals: DataFrame, label: str, name: str, of_shown: bool = True) -> DataFrame:
    shares = column_percent(totals, ["total_rev"], bounded=True) if of_shown else totals
    return shares.orderBy(F.desc("total_rev"), label).select(
        F.col("jurisdiction").alias("Jurisdiction"),
        F.col(label).alias(name),
        percent_text("total_rev").alias("Total Revenue"),
    )


def sector_totals(sales: DataFrame, sectors: DataFrame, jurisdiction: str, year: str) -> DataFrame:
    """Yearly sales per sector; codes without a description form a group of their own."""
    rows = mutate(sales, ("sector", _sector()), (AMOUNT, num(AMOUNT)))
    return (
        merge_left(rows, sectors, "sector")
        .groupBy("sales_tax_year", "jurisdiction", "sector_description")
        .agg(sum0(AMOUNT).alias("total_rev"))
        .where((F.col("jurisdiction") == jurisdiction) & (F.col("sales_tax_year") == year))
    )


def sector_descriptions(sales: DataFrame, sectors: DataFrame) -> DataFrame:
    """Description of every two-digit code in use, missing for codes the sector table lacks."""
    codes = distinct_rows(sales.withColumn("sector", _sector()), "sector")
    return merge_left(codes, sectors, "sector")


def top_sectors(
    sales: DataFrame,
    sectors: DataFrame,
    jurisdiction: str,
    year: str,
    n: int = 10,
    pct_of: str = "kept",
) -> DataFrame:
    """The largest sectors with their percentage of the kept sectors' or of all sectors' sales."""
    if pct_of not in ("kept", "all"):
        raise ValueError("pct_of is 'kept' or 'all'")
    totals = sector_totals(sales, sectors, jurisdiction, year)
    if pct_of == "all":
        totals = column_percent(totals, ["total_rev"], bounded=True)
    top = slice_max(totals, "total_rev", n, bounded=True)
    return _ranked(top, "sector_description", "Sector", of_shown=pct_of == "kept")


def top_industry_by_county(sales: DataFrame) -> DataFrame:
    """The industry with the largest sales in each county and year; ties stay."""
    totals = county_totals(sales, "total_rev")
    return slice_max(totals, "total_rev", 1, by=["sales_tax_year", "county"], bounded=True)


def industry_share(
    sales: DataFrame, industries: Sequence[str] = WAYFAIR_INDUSTRIES
) -> DataFrame:
    """Sales of some industries and their percentage of all industries, by county and year.

    The shares are taken over the county's whole year before the industries are picked.
    """
    totals = county_totals(sales, "Revenue", first_year_only=True)
    percent = "Percent of total revenue"
    shares = share(totals, {percent: "Revenue"}, ["sales_tax_year", "county"], bounded=True)
    picked = shares.withColumn(percent, F.col(percent) * 100).where(
        F.col("naics_industry_group").isin(*industries)
    )
    return pivot_longer(picked, ["Revenue", percent])


def quarterly_series(
    sales: DataFrame,
    jurisdictions: Sequence[str] = WAYFAIR_JURISDICTIONS,
    industry: str | None = None,
) -> DataFrame:
    """Quarterly rows of some jurisdictions, dated by the first month of the selling period.

    The year of the date is the tax year's first, also for a period that starts in December.
    """
    rows = sales.where(F.col("jurisdiction").isin(*jurisdictions))
    if industry is not None:
        rows = rows.where(F.col("naics_industry_group") == industry)
    parts = mutate(
        rows,
        (AMOUNT, num(AMOUNT)),
        ("sales_tax_year", replace_first("sales_tax_year", " .*", "")),
        ("selling_period", replace_first("selling_period", " .*", "")),
        ("month", month_no("selling_period")),
    )
    dated = unite(parts, "date", ["sales_tax_year", "month"], sep="/")
    return dated.withColumn("date", year_month("date")).orderBy("date", "jurisdiction")


def _is_fourth_quarter() -> Column:
    return F.col("sales_tax_quarter") == "4"


def fourth_quarter(sales: DataFrame) -> DataFrame:
    """Fourth-quarter rows of the counties, without the roll-ups."""
    rows = clean_counties(sales.where(_is_fourth_quarter()))
    return rows.where(not_in("county", SALES_ROLLUPS))


def top_industries_q4(sales: DataFrame, sectors: DataFrame, n: int = 5) -> DataFrame:
    """The first n industries of each year by fourth-quarter sales; ties are cut by code."""
    code = "naics_industry_group"
    named = named_totals(sales.where(_is_fourth_quarter()), "total", [code])
    counties = named.where(not_in("county", SALES_ROLLUPS)).withColumn("sector", _sector())
    totals = merge_left(counties, sectors, "sector")
    totals = totals.groupBy("sales_tax_year", code).agg(sum0("total").alias("total"))
    return slice_head(totals, n, [F.desc("total"), F.asc(code)], by=["sales_tax_year"])


def sales_frequency(sales: DataFrame, column: str) -> DataFrame:
    """How often each description, industry group or jurisdiction occurs."""
    return frequency(sales, column)
