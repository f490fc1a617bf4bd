"""Tables behind the maps: boundaries joined to measures. Geometry is carried, never evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from levylens.constants import AGI, CITY_COUNTIES, RETURNS
from levylens.functions import log10, not_in, ratio, sum0
from levylens.operators import dimension_left_join, left_join
from levylens.operators.classes import classify, classify_by, natural_breaks, natural_breaks_by
from levylens.plans.sales import AMOUNT, fourth_quarter


def county_map(
    boundary: DataFrame, counties: DataFrame, year: int = 2019, bounded: bool = False
) -> DataFrame:
    """Every county boundary with the measures of a year, income also in millions."""
    rows = counties.where(F.col("tax_year") == year).withColumn(
        "ny_agi_of_all_returns_in_millions", F.col(AGI) * 1e-6
    )
    return dimension_left_join(boundary, rows, bounded)


def county_classes(mapped: DataFrame, k: int = 5, log: bool = False) -> DataFrame:
    """`county_map` with the natural-break class of income, on a log scale if wanted.

    Finding the breaks runs a job over `mapped`, so give a stored table.
    """
    measure = log10(AGI) if log else F.col(AGI)
    return mapped.withColumn("class", classify(measure, natural_breaks(mapped, measure, k)))


def county_classes_by_year(counties: DataFrame, k: int = 5, log: bool = False) -> DataFrame:
    """Every year's counties with the natural-break class of their income among that year's, all
    years in the same jobs. Give a stored table."""
    measure = log10(AGI) if log else F.col(AGI)
    rows = counties.withColumn("measured", measure)
    breaks = natural_breaks_by(rows, "measured", k, ["tax_year"])
    return classify_by(rows, "measured", "class", breaks, ["tax_year"]).drop("measured")


def sales_per_return(counties: DataFrame, sales: DataFrame) -> DataFrame:
    """Taxable sales per income tax return by year and county.

    `sales` has the columns tax_year, county and the amount as a number. Where both tables are
    bucketed by year and county nothing is shuffled, neither for the sum nor for the join.
    """
    by = ["tax_year", "county"]
    totals = sales.groupBy(*by).agg(sum0(AMOUNT).alias("total_rev"))
    joined = counties.select(*by, RETURNS).join(totals, by)
    return joined.select(*by, RETURNS, "total_rev", ratio("total_rev", RETURNS).alias("per_return"))


def top_industry_map(boundary: DataFrame, top_industry: DataFrame) -> DataFrame:
    """County boundaries outside New York City with each year's top industry.

    `top_industry` is an aggregate: one row per county and year unless industries tie.
    """
    outside = boundary.where(not_in("county", CITY_COUNTIES))
    return left_join(outside, top_industry).withColumnRenamed("description", "Industry")


def unmatched_regions(mapped: DataFrame) -> DataFrame:
    """Boundaries no sales row was found for."""
    return mapped.where(F.col("sales_tax_year").isNull())


def complete_regions(mapped: DataFrame) -> DataFrame:
    """Rows without any missing value."""
    return mapped.dropna("any")


def one_year_map(mapped: DataFrame, year: str) -> DataFrame:
    return mapped.where(F.col("sales_tax_year") == year).drop("GEOID")


def fourth_quarter_map(boundary: DataFrame, sales: DataFrame, bounded: bool = False) -> DataFrame:
    """Fourth-quarter sales rows at their boundary."""
    rows = dimension_left_join(boundary, fourth_quarter(sales), bounded)
    return rows.where(F.col("sales_tax_quarter").isNotNull())
