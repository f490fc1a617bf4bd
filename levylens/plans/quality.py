"""Checks of coverage and of names between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from levylens.constants import AGI, MISLABELLED_HAMILTON_AGI_K
from levylens.operators import (
    Presence, anti_join, bind_rows, count_rows, distinct_rows, first_per_key, intersect_keys, presence,
    setdiff_keys,
)
from levylens.plans.sales import county_names


def counties_per_year(counties: DataFrame) -> DataFrame:
    return count_rows(counties, ["tax_year"])


def rows_per_county_year(long: DataFrame) -> DataFrame:
    return count_rows(long, ["county", "tax_year"])


def county_years(counties: DataFrame) -> DataFrame:
    return distinct_rows(counties, "tax_year", "county")


def first_row_per_county(counties: DataFrame, year: int) -> DataFrame:
    """One row per county of a year, leaving out the misfiled amount."""
    plausible = counties.where(F.col(AGI) != MISLABELLED_HAMILTON_AGI_K * 1000)
    return first_per_key(plausible.where(F.col("tax_year") == year), ["county"])


def coverage(counties: DataFrame) -> Presence:
    """Which counties have a plausible row in which year, from one pass over the table."""
    plausible = counties.where(F.col(AGI) != MISLABELLED_HAMILTON_AGI_K * 1000)
    return presence(plausible, ["county"], ["tax_year"])


def names_only_in_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """The county names of one table that another lacks, from the bitmaps of both."""
    both = bind_rows(
        *[t.select("county", F.lit(i).alias("side")) for i, t in enumerate((first, second))]
    )
    names = presence(both, ["county"], ["side"])
    return names.only_in(F.col("side") == 0, F.col("side") == 1)


def counties_in_both(counties: DataFrame, year: int, other_year: int) -> DataFrame:
    return intersect_keys(
        first_row_per_county(counties, year), first_row_per_county(counties, other_year), "county"
    )


def counties_missing_in(counties: DataFrame, year: int, present_in: int) -> DataFrame:
    """Rows of the year `present_in` whose county has no plausible row in `year`.

    Leaving out the counties of both years from those of one is the same as leaving out those of
    the other.
    """
    rows = first_row_per_county(counties, present_in)
    return anti_join(rows, first_row_per_county(counties, year), ["county"])


def boundaries_without_sales(boundary: DataFrame, sales: DataFrame) -> DataFrame:
    """County names of the boundary table that the cleaned sales table lacks."""
    names = county_names(distinct_rows(sales, "jurisdiction"))
    return setdiff_keys(boundary, names, "county")
