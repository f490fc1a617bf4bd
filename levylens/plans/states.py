"""Income tax by state of residence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from levylens.constants import (
    AGI, LEGACY_STATES, LIABILITY, MEASURES, NEIGHBOURS, NOT_CONTIGUOUS, RETURNS, STATE_NAMES,
    STATE_TOTAL_COUNTIES,
)
from levylens.functions import (
    comma, if_else_na, log10, mean_strict, not_in, paste, sum0, sum_strict,
)
from levylens.operators import (
    bind_rows, merge_inner, mutate, pivot_longer, relocate, set_names, share,
    slice_max, summarise_at, totals_row,
)
from levylens.plans.income import V1_AGI_K, V1_LIABILITY_K, v1_dollars, v1_numbers, v2_numbers

NY_AGI = "new_york_state_amount_of_ny_adjusted_gross_income"
FEDERAL_AGI = "federal_amount_of_ny_adjusted_gross_income"


def _all_returns(raw_v2: DataFrame) -> Column:
    return F.col("tax_liability_status") == "All Returns"


def _v2_measures(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.col(FEDERAL_AGI).alias(AGI),
        F.col("tax_liability").alias(LIABILITY),
        F.col("number_of_returns").alias(RETURNS),
    )


def _named_or_other(named: Sequence[str]) -> Column:
    state = F.col("state")
    return if_else_na(not_in(state, named), F.lit("Other states"), state)


def neighbour_states(raw_v1: DataFrame, raw_v2: DataFrame) -> DataFrame:
    """States other than New York; those not reported on their own are grouped in `new`."""
    elsewhere = F.col("state").isin(*STATE_NAMES) & (F.col("state") != "New York")
    new = _named_or_other(NEIGHBOURS)
    v1 = v1_numbers(raw_v1.where((F.col("income_class") == "Total") & elsewhere))
    v1 = relocate(v1_dollars(v1).withColumn("new", new), "new", before="state")
    v2 = v2_numbers(raw_v2.where(_all_returns(raw_v2) & elsewhere))
    v2 = relocate(v2.withColumn("new", new), "new", before="state")
    return bind_rows(
        v1.select("tax_year", "new", "state", *MEASURES),
        _v2_measures(v2, "tax_year", "new", "state"),
    )


def neighbour_trend(neighbours: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Tax of each neighbour, and of all other states together, by year."""
    if only is not None:
        neighbours = neighbours.where(F.col("state").isin(*only))
    sums = neighbours.groupBy("tax_year", "new").agg(sum_strict(LIABILITY).alias("sum"))
    return sums.withColumnRenamed("new", "State")


def states(raw_v1: DataFrame, raw_v2: DataFrame) -> DataFrame:
    """One row per state and year, New York included."""
    a_state = F.col("state").isin(*STATE_NAMES)
    v1 = raw_v1.where(
        (F.col("income_class") == "Total") & F.col("county").isin(*STATE_TOTAL_COUNTIES) & a_state
    )
    v2 = raw_v2.where(
        _all_returns(raw_v2)
        & F.col("place_of_residence").isin(*STATE_NAMES, "All Places")
        & F.col("county").isin("All", "All Places")
        & a_state
    )
    return bind_rows(
        v1_dollars(v1_numbers(v1)).select("tax_year", "state", *MEASURES),
        _v2_measures(v2_numbers(v2), "tax_year", "state"),
    )


def state_share_long(
    state_rows: DataFrame,
    variables: Sequence[str] = ("percLiability",),
    bounded: bool = False,
) -> DataFrame:
    """Each state's share of the year's tax ("percLiability") or income ("percAGI").

    Only the wanted measures are computed: a filter on `variable` afterwards would not save them.
    """
    measure = {"percLiability": LIABILITY, "percAGI": AGI}
    shares = share(state_rows, {v: measure[v] for v in variables}, ["tax_year"], bounded)
    return pivot_longer(shares.select("tax_year", "state", *variables), list(variables))


def resident_share(state_rows: DataFrame) -> DataFrame:
    """Share of the year's tax paid by New York and by all other states together.

    After the sums only the year still groups the rows: two of them per year.
    """
    elsewhere = if_else_na(F.col("state") == "New York", F.lit("New York"), F.lit("Other States"))
    sums = (
        state_rows.withColumn("category", elsewhere)
        .groupBy("tax_year", "category")
        .agg(sum0(LIABILITY).alias("sumliability"))
    )
    shares = share(sums, {"percLiability": "sumliability"}, ["tax_year"], bounded=True)
    return pivot_longer(shares.select("tax_year", "category", "percLiability"), ["percLiability"])


def other_states_mean(shares: DataFrame) -> DataFrame:
    """Mean over the years of the share paid by other states."""
    others = shares.where(F.col("category") == "Other States")
    return others.agg(mean_strict("value").alias("mean_value"))


def top_states(
    table: DataFrame, measure: str, year: int = 2019, n: int = 10, bounded: bool = False
) -> DataFrame:
    """The n largest states of a year, smallest of them first as in the bar chart."""
    top = slice_max(table.where(F.col("tax_year") == year), measure, n, bounded=bounded)
    return top.orderBy(F.asc(measure), "state")


def state_totals(table: DataFrame, year: int = 2019) -> DataFrame:
    """The states of a year and a row of totals."""
    return totals_row(table.where(F.col("tax_year") == year), bounded=True)


def legacy_state_groups(raw_v1: DataFrame, raw_v2: DataFrame) -> DataFrame:
    """Returns, income and tax (thousands) of three neighbours, New York and all other states."""
    a_state = F.col("state").isin(*STATE_NAMES)
    new = _named_or_other(LEGACY_STATES)
    names = ["tax_year", "new", RETURNS, V1_AGI_K, V1_LIABILITY_K]
    keys = ["tax_year", "new"]

    v1 = raw_v1.where((F.col("income_class") != "Total") & a_state).withColumn("new", new)
    v1 = v1_numbers(v1, "place_of_residence_sort_order")
    v1 = summarise_at(v1, keys, [RETURNS, V1_AGI_K, V1_LIABILITY_K], sum0)

    v2 = raw_v2.where(_all_returns(raw_v2) & a_state).withColumn("new", new)
    v2 = mutate(
        v2_numbers(v2),
        ("agi_k", F.col(NY_AGI) / 1000),
        ("liability_k", F.col("tax_liability") / 1000),
    )
    v2 = summarise_at(v2, keys, ["number_of_returns", "agi_k", "liability_k"], sum0)
    return bind_rows(v1.select(*names), set_names(v2, names))


def top_legacy_groups(groups: DataFrame, year: int = 1999, n: int = 5) -> DataFrame:
    """The groups of a year without New York, by number of returns."""
    rows = groups.where((F.col("tax_year") == year) & (F.col("new") != "New York"))
    return slice_max(rows, RETURNS, n, bounded=True)


def agi_definition_compare(raw_v1: DataFrame, raw_v2: DataFrame) -> DataFrame:
    """Income of the other states by year under each definition the data offers."""
    elsewhere = F.col("state").isin(*STATE_NAMES) & (F.col("state") != "New York")
    v1 = v1_numbers(
        raw_v1.where(
            (F.col("income_class") == "Total")
            & F.col("county").isin(*STATE_TOTAL_COUNTIES)
            & elsewhere
        )
    )
    v1 = v1.select("tax_year", (F.col(V1_AGI_K) * 1000).alias("ny_agi_of_all_returns"))
    v2 = raw_v2.where(
        _all_returns(raw_v2)
        & F.col("place_of_residence").isin(*STATE_NAMES, "All Places")
        & F.col("county").isin("All", "All Places")
        & elsewhere
    )
    v2 = v2_numbers(v2).select("tax_year", NY_AGI, FEDERAL_AGI)
    rows = bind_rows(
        pivot_longer(v1, ["ny_agi_of_all_returns"]), pivot_longer(v2, [NY_AGI, FEDERAL_AGI])
    )
    return rows.groupBy("tax_year", "variable").agg(sum0("value").alias("total"))


def od_flows(
    neighbours: DataFrame, centers: DataFrame, year: int = 2019, tooltip_scale: float = 1.0
) -> DataFrame:
    """Tax flows into New York: both end points, amount, arc width and tooltip of each state.

    `centers` is the fixed table of fifty states; New York's point is a scalar taken from it.
    """
    ny = centers.where(F.col("state_name") == "New York")
    amounts = neighbours.where(F.col("tax_year") == year).select("state", LIABILITY)
    amount = F.col(LIABILITY)
    flows = mutate(
        merge_inner(centers, amounts, "state_name", "state"),
        ("destination_x", ny.select("x").scalar()),
        ("destination_y", ny.select("y").scalar()),
        ("width", log10(amount)),
        ("tooltip", paste("state_name", F.lit(", "), comma(amount * tooltip_scale))),
    )
    return flows.where(not_in("state_name", NOT_CONTIGUOUS)).select(
        F.col("state_name").alias("state"),
        F.col("x").alias("origin_x"),
        F.col("y").alias("origin_y"),
        "destination_x",
        "destination_y",
        LIABILITY,
        "width",
        "tooltip",
    )
