"""The batch build: from raw tables to the published bundle and the exports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from levylens.plans import income, sales, states
from levylens.sources import readers, sinks, snapshots

BASE, DASHBOARD = "base", "dashboard"
#: The columns by whose values the dashboard's views pick rows.
PICKED_BY = {
    "region_per_return": ["variable", "tax_year"],
    "effective_rate": ["tax_year", "income_group_ord"],
    "resident_share": ["tax_year", "category"],
    "state_share": ["state", "tax_year"],
    "industry_share": ["description", "county", "variable"],
}


def normalised(raw_v1: DataFrame, raw_v2: DataFrame) -> dict[str, DataFrame]:
    """The two tables most analyses start from."""
    return {
        "county_income": income.county_income(raw_v1, raw_v2),
        "states": states.states(raw_v1, raw_v2),
    }


def dashboard_tables(
    raw_v1: DataFrame,
    raw_sales: DataFrame,
    county_income: DataFrame,
    state_rows: DataFrame,
    rate_years: tuple[int, int] = (2007, 2014),
    bounded: bool = False,
) -> dict[str, DataFrame]:
    return {
        "region_per_return": income.region_per_return(county_income),
        "effective_rate": income.effective_rate(raw_v1, *rate_years),
        "resident_share": states.resident_share(state_rows),
        "state_share": states.state_share_long(state_rows, bounded=bounded),
        "industry_share": sales.industry_share(raw_sales),
    }


def build(
    raw_v1: DataFrame,
    raw_v2: DataFrame,
    raw_sales: DataFrame,
    root: str,
    rate_years: tuple[int, int] = (2007, 2014),
    keep: int = snapshots.KEPT,
) -> str:
    """Write the normalised tables, then everything the dashboard reads from them, as a new bundle
    with the parts BASE and DASHBOARD; return its folder.

    Later steps read the written tables, so a lost executor never costs the normalisation again.
    The bundle becomes the current one when it is whole, so whoever reads the one before goes on
    undisturbed; `snapshots` keeps the newest `keep`. Dashboard tables are clustered by what views
    pick, so that a view reads the few row groups that hold it.
    """
    spark = raw_v1.sparkSession

    def write(folder: str) -> None:
        base = normalised(raw_v1, raw_v2)
        sinks.save_bundle(base, f"{folder}/{BASE}")
        saved = readers.bundle(spark, f"{folder}/{BASE}", base)
        tables = dashboard_tables(
            raw_v1, raw_sales, saved["county_income"], saved["states"], rate_years
        )
        for name, table in tables.items():
            by = PICKED_BY[name]
            sinks.save_clustered(table, f"{folder}/{DASHBOARD}/{name}", by, bloom=by[:1])

    return snapshots.publish(spark, root, write, keep)


def add_years(counties: DataFrame, path: str) -> None:
    """Write the years that `counties` holds into the table of counties by year, each of them
    replacing what is there; other years are neither read nor written."""
    sinks.replace_partitions(counties, path, "tax_year")


def export(
    view_table: DataFrame,
    county_income: DataFrame,
    state_rows: DataFrame,
    root: str,
    on: datetime.date | None = None,
) -> str:
    """The download behind a view (its whole table) and the two-sheet export."""
    sinks.export_sheets({"NY Counties": county_income, "States": state_rows}, f"{root}/sheets")
    return sinks.export_csv(view_table, root, on)
