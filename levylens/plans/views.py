"""Data side of the dashboard: published tables filtered by what a user picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from levylens.functions import dollar, month_label, percent_label, unit_label
from levylens.operators import choices

PERCENT = "Percent of total revenue"


def region_view(regions: DataFrame, variable: str) -> DataFrame:
    return regions.where(F.col("variable") == variable).orderBy("tax_year", "region")


def share_view(shares: DataFrame) -> DataFrame:
    return shares.orderBy("tax_year", "category")


def states_view(shares: DataFrame, states: Sequence[str]) -> DataFrame:
    picked = shares.where(F.col("state").isin(*states))
    return picked.orderBy("tax_year", "state")


def industry_view(
    industry_shares: DataFrame, industry: str, counties: Sequence[str], variable: str = "Revenue"
) -> DataFrame:
    """Revenue, or with `variable=PERCENT` its share of all industries, of one industry."""
    picked = industry_shares.where(
        (F.col("variable") == variable)
        & (F.col("description") == industry)
        & F.col("county").isin(*counties)
    )
    return picked.orderBy("sales_tax_year", "county")


def dollar_labels(view: DataFrame) -> DataFrame:
    """Whole dollars with thousands separators, as on the axis of `region_view`."""
    return view.withColumn("label", dollar("value"))


def percent_labels(view: DataFrame) -> DataFrame:
    """Whole percentages, as on the axes of the share views."""
    return view.withColumn("label", percent_label("value"))


def unit_labels(view: DataFrame, measure: str, unit: str, digits: int = 1) -> DataFrame:
    """Billions ("B"), millions ("M") or thousands ("T") of a measure."""
    return view.withColumn("label", unit_label(measure, unit, digits))


def month_labels(series: DataFrame) -> DataFrame:
    """Month and year of the dates of `quarterly_series`."""
    return series.withColumn("month", month_label("date"))


def variable_choices(regions: DataFrame) -> DataFrame:
    return choices(regions, "variable")


def state_choices(shares: DataFrame) -> DataFrame:
    return choices(shares, "state")


def industry_choices(industry_shares: DataFrame) -> DataFrame:
    return choices(industry_shares, "description")


def county_choices(industry_shares: DataFrame) -> DataFrame:
    return choices(industry_shares, "county")
