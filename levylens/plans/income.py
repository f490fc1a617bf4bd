"""Personal income tax by county and by income group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levylens.constants import (
    AGI, DOWNSTATE, INCOME_GROUPS, LIABILITY, MEASURES, MISLABELLED_HAMILTON_AGI_K,
    RATE_CAPTION, RETURNS, STATE_TOTAL_COUNTIES, V1_NOT_COUNTIES, V2_NOT_COUNTIES,
)
from levylens.functions import (
    case_ordered, if_else_na, is_in, ltrim_ws, mean_strict, not_in, num, paste, ratio,
    replace_first, rounded_text, sum0, sum_strict, whole,
)
from levylens.operators import (
    bind_rows, col_range, mutate, mutate_at, pivot_longer, select_positions,
    semi_join, six_number_summary, slice_max, slice_min, summarise_at,
)
from levylens.sources.sinks import staged

V1_AGI_K = "ny_agi_of_all_returns_in_thousands"
V1_LIABILITY_K = "tax_liability_of_all_returns_in_thousands"


def v1_numbers(raw: DataFrame, first: str = RETURNS) -> DataFrame:
    """Parse the year and the measures of the 1999-2014 table."""
    measures = col_range(raw, first, V1_LIABILITY_K)
    return mutate_at(mutate(raw, ("tax_year", whole("tax_year"))), measures, num)


def v2_numbers(raw: DataFrame) -> DataFrame:
    """Parse the year and the measures of the 2015-2019 table."""
    last = "number_filing_married_separate_or_widow_widower"
    measures = col_range(raw, "number_of_returns", last)
    return mutate_at(mutate(raw, ("tax_year", whole("tax_year"))), measures, num)


def v1_dollars(df: DataFrame) -> DataFrame:
    """Thousands to dollars."""
    return mutate(df, (AGI, F.col(V1_AGI_K) * 1000), (LIABILITY, F.col(V1_LIABILITY_K) * 1000))


def county_income_v1(raw: DataFrame) -> DataFrame:
    """County rows of the 1999-2014 table with clean names and amounts in dollars."""
    counties = raw.where(
        (F.col("state") == "New York")
        & (F.col("income_class") == "Total")
        & not_in("county", V1_NOT_COUNTIES)
    )
    county = F.col("county")
    misfiled = (county == "Hamilton") & (F.col(V1_AGI_K) == MISLABELLED_HAMILTON_AGI_K)
    named = mutate(
        v1_numbers(counties),
        ("county", ltrim_ws("county")),
        ("county", replace_first("county", "New York City - ", "")),
        ("county", if_else_na(county == "Manhattan", F.lit("New York"), county)),
        ("county", if_else_na(misfiled, F.lit("Greene"), county)),
    )
    return v1_dollars(named).select("tax_year", "county", *MEASURES)


def county_income_v2(raw: DataFrame) -> DataFrame:
    """County rows of the 2015-2019 table; Manhattan is renamed before blanks are trimmed."""
    counties = raw.where(
        (F.col("state") == "New York")
        & (F.col("tax_liability_status") == "All Returns")
        & not_in("county", V2_NOT_COUNTIES)
    )
    county = F.col("county")
    named = mutate(
        v2_numbers(counties),
        ("county", if_else_na(county == "Manhattan", F.lit("New York"), county)),
        ("county", ltrim_ws("county")),
    )
    return named.select(
        "tax_year",
        "county",
        F.col("new_york_state_amount_of_ny_adjusted_gross_income").alias(AGI),
        F.col("tax_liability").alias(LIABILITY),
        F.col("number_of_returns").alias(RETURNS),
    )


def county_income(raw_v1: DataFrame, raw_v2: DataFrame) -> DataFrame:
    """Both eras: tax_year, county and the three measures."""
    return bind_rows(county_income_v1(raw_v1), county_income_v2(raw_v2))


def county_income_long(counties: DataFrame) -> DataFrame:
    """One row per county, year and measure."""
    return mutate(pivot_longer(counties, MEASURES), ("county", ltrim_ws("county")))


def region_per_return(counties: DataFrame) -> DataFrame:
    """Income and tax per return, downstate against upstate, by year."""
    region = if_else_na(is_in("county", DOWNSTATE), F.lit("Downstate"), F.lit("Upstate"))
    sums = summarise_at(
        counties.withColumn("region", region), ["tax_year", "region"], MEASURES, sum_strict, "_sum"
    )
    per_return = mutate(
        sums,
        ("AGI per returnee", ratio(f"{AGI}_sum", f"{RETURNS}_sum")),
        ("Tax liability per returnee", ratio(f"{LIABILITY}_sum", f"{RETURNS}_sum")),
    )
    kept = select_positions(per_return, [1, 2, 6, 7])
    return pivot_longer(kept, ["AGI per returnee", "Tax liability per returnee"])


def county_extremes(
    counties: DataFrame,
    measure: str,
    year: int = 2019,
    n: int = 5,
    largest: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """The whole series of the n counties with the largest or smallest value in one year.

    A bounded input is read once, with one window per year and one per county. Otherwise the
    counties are picked first and the table is read again through a semi-join on them.
    """
    in_year = F.col("tax_year") == year
    if not bounded:
        chosen = (slice_max if largest else slice_min)(counties.where(in_year), measure, n)
        names = staged(chosen.select("county").distinct(), "counties")
        return semi_join(counties, names, ["county"])
    order = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
    rank = F.rank().over(W.partitionBy("tax_year").orderBy(order))
    picked = in_year & F.col(measure).isNotNull() & (F.col("_rank") <= n)
    flagged = mutate(
        counties,
        ("_rank", rank),
        ("_picked", F.max(picked).over(W.partitionBy("county"))),
    )
    return flagged.where("_picked").drop("_rank", "_picked")


def county_ranking(counties: DataFrame, year: int = 2019) -> DataFrame:
    """All counties of a year, smallest income first, as the bars of the figure are stacked."""
    one_year = counties.where(F.col("tax_year") == year).select("county", AGI)
    return one_year.orderBy(F.asc_nulls_last(AGI), "county")


def top_counties_each_year(counties: DataFrame, n: int = 5, bounded: bool = False) -> DataFrame:
    return slice_max(counties, RETURNS, n, by=["tax_year"], bounded=bounded)


def measure_summary(
    table: DataFrame, measure: str, by_year: bool = True, bounded: bool = False
) -> DataFrame:
    """Six-number summary and total of a measure, for every year at once or over all years."""
    return six_number_summary(table, measure, ["tax_year"] if by_year else [], bounded)


def income_group() -> tuple[Column, Column]:
    """Label and order of the six groups the thirteen raw classes fold into."""
    return case_ordered([(is_in("income_class", raw), label) for label, raw in INCOME_GROUPS])


def effective_rate(raw_v1: DataFrame, first_year: int = 2007, last_year: int = 2014) -> DataFrame:
    """Tax as a share of income for each income group and year."""
    rows = v1_numbers(raw_v1, "income_class_sort_order").where(
        F.col("county").isin(*STATE_TOTAL_COUNTIES)
        & (F.col("state") == "New York")
        & F.col("tax_year").between(first_year, last_year)
        & (F.col("income_class") != "Total")
    )
    label, order = income_group()
    grouped = (
        v1_dollars(rows.withColumns({"income_group": label, "income_group_ord": order}))
        .groupBy("tax_year", "income_group", "income_group_ord")
        .agg(sum0(AGI).alias("sumAGI"), sum0(LIABILITY).alias("sumLiability"))
    )
    rates = grouped.select(
        "tax_year", "income_group", "income_group_ord",
        ratio("sumLiability", "sumAGI").alias("taxRate"),
    )
    return pivot_longer(rates, ["taxRate"])


def rate_view(rates: DataFrame, year: int = 2014) -> DataFrame:
    """One year of `effective_rate` with the plain mean over groups and its caption.

    The window holds the income groups of one year.
    """
    mean = mean_strict("value", over=W.partitionBy("tax_year"))
    caption = paste(
        F.lit(RATE_CAPTION[0]),
        rounded_text(F.col("mean_value") * 100),
        F.lit(RATE_CAPTION[1]),
        F.lit(year),
        sep=" ",
    )
    return mutate(
        rates.where(F.col("tax_year") == year), ("mean_value", mean), ("caption", caption)
    ).orderBy("income_group_ord")
