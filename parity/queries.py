"""Every analysis run on the order-entry tables of a folder.

What `order_tables` returns is already aggregated to years x places x classes (or quarters x
jurisdictions x industries) whatever the size of the folder, hence `bounded=True` downstream.
Measures are rounded because two engines add floating-point numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from levylens.constants import AGI, LIABILITY, RETURNS
from levylens.functions import date_lit
from levylens.operators import arrange_desc
from levylens.plans import income, maps, publish, quality, sales, states, views
from levylens.session import fit_shuffles
from levylens.sources import order_tables, readers, sinks, snapshots
from levylens.sources.reference import state_centers
from parity import features
from parity.verbs import VERBS, Reader, reader

YEAR = 2000
SALES_YEAR = "1999 - 2000"
SALES_START = 1999
RATE_YEARS = (1996, 1998)
JURISDICTION = "NY STATE"
TEN_STATES = [
    "New Jersey", "Connecticut", "California", "Florida", "Texas", "Pennsylvania",
    "Massachusetts", "Ohio", "Illinois", "Georgia",
]
MEASURE_KEYS = {"agi": AGI, "liability": LIABILITY, "returns": RETURNS}

Query = Callable[[SparkSession, str], DataFrame]


# Decimals kept, by result column. Shares and logarithms need more than money; quantiles have up
# to six exact decimals; a mean or a sum of thousands may sit on an edge behind the cent, where the
# last bit of a floating-point sum decides.
MONEY, EXACT, SUMMED = 4, 6, 2
_DECIMALS = {
    "share": 10, "per_return": 8,
    "value": EXACT, "mean_value": EXACT, "width": EXACT,
    "min": EXACT, "q1": EXACT, "median": EXACT, "q3": EXACT, "max": EXACT,
    "mean": SUMMED, "total": SUMMED,
    "ny_agi_of_all_returns_in_thousands": SUMMED,
    "tax_liability_of_all_returns_in_thousands": SUMMED,
}


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), _DECIMALS.get(c, MONEY)) for c in doubles})


class Tables:
    """The raw and normalised tables of one folder."""

    def __init__(
        self, spark: SparkSession, folder: str, years: tuple[int, int] | None = None
    ):
        self.spark, self.folder, self.years = spark, folder, years

    def only(self, first: int, last: int | None = None) -> Tables:
        """The tables of these years: what one-year analyses read."""
        return Tables(self.spark, self.folder, (first, last or first))

    @property
    def v1(self) -> DataFrame:
        return order_tables.raw_income_v1(self.spark, self.folder, self.years)

    @property
    def v2(self) -> DataFrame:
        return order_tables.raw_income_v2(self.spark, self.folder, self.years)

    @property
    def sales(self) -> DataFrame:
        return order_tables.raw_sales(self.spark, self.folder, self.years)

    @property
    def sectors(self) -> DataFrame:
        return order_tables.sectors(self.spark)

    @property
    def boundary(self) -> DataFrame:
        return readers.counties_of(order_tables.boundaries(self.spark, self.folder))

    @property
    def counties(self) -> DataFrame:
        return income.county_income(self.v1, self.v2)

    @property
    def regions(self) -> DataFrame:
        return income.region_per_return(self.counties)

    @property
    def rates(self) -> DataFrame:
        return income.effective_rate(self.only(*RATE_YEARS).v1, *RATE_YEARS)

    @property
    def neighbours(self) -> DataFrame:
        return states.neighbour_states(self.v1, self.v2)

    @property
    def states(self) -> DataFrame:
        return states.states(self.v1, self.v2)

    @property
    def county_map(self) -> DataFrame:
        return maps.county_map(self.boundary, self.only(YEAR).counties, YEAR, bounded=True)

    @property
    def industry_map(self) -> DataFrame:
        return maps.top_industry_map(self.boundary, sales.top_industry_by_county(self.sales))


def _publish_roundtrip(t: Tables) -> DataFrame:
    """Build and export everything, then read it back: rows and value total of each table."""
    root = sinks.shared_folder(t.spark, "publish")
    publish.build(t.v1, t.v2, t.sales, root, RATE_YEARS)
    folder = snapshots.current(t.spark, root)
    names = [
        "region_per_return", "effective_rate", "resident_share", "state_share", "industry_share",
    ]
    tables = readers.bundle(t.spark, f"{folder}/{publish.DASHBOARD}", names)
    base = readers.bundle(t.spark, f"{folder}/{publish.BASE}", ["county_income", "states"])
    csv = publish.export(tables["region_per_return"], base["county_income"], base["states"], root)
    tables["csv"] = readers.dimension_csv(t.spark, csv, tables["region_per_return"].schema)
    for sheet, name in (("NY Counties", "county_income"), ("States", "states")):
        copy = readers.dimension_csv(t.spark, f"{root}/sheets/{sheet}", base[name].schema)
        tables[f"sheet {sheet}"] = copy.withColumn("value", F.col(RETURNS))
    summaries = [
        df.agg(F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total")).select(
            F.lit(name).alias("name"), "row_count", "total"
        )
        for name, df in tables.items()
    ]
    out = summaries[0]
    for other in summaries[1:]:
        out = out.unionByName(other)
    return out


def _exports(t: Tables) -> DataFrame:
    """Each download of the dashboard, written as CSV and read again: rows and value total."""
    rows = t.counties
    downloads = {
        "region_per_return": t.regions,
        "effective_rate": t.rates,
        "resident_share": states.resident_share(t.states),
        "state_share": states.state_share_long(t.states, bounded=True),
        "industry_share": sales.industry_share(t.sales),
        "county_income": rows.withColumn("value", F.col(RETURNS)),
    }
    out = None
    for name, table in downloads.items():
        path = sinks.export_csv(table, sinks.shared_folder(t.spark, name))
        copy = readers.dimension_csv(t.spark, path, table.schema)
        row = copy.agg(F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total"))
        row = row.select(F.lit(name).alias("name"), "row_count", "total")
        out = row if out is None else out.unionByName(row)
    return out


def _table_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    q: dict[str, Callable[[Tables], DataFrame]] = {
        # income tax by county
        "region_per_return": lambda t: t.regions,
        "county_income_v1": lambda t: income.county_income_v1(t.v1),
        "county_income_v2": lambda t: income.county_income_v2(t.v2),
        "county_income": lambda t: t.counties,
        "county_income_long": lambda t: income.county_income_long(t.counties),
        "county_ranking": lambda t: income.county_ranking(t.only(YEAR).counties, YEAR),
        "top_counties_each_year": lambda t: income.top_counties_each_year(
            t.counties, bounded=True
        ),
        "county_map": lambda t: t.county_map,
        "county_classes": lambda t: maps.county_classes(sinks.staged(t.county_map, "map")),
        "county_classes_log": lambda t: maps.county_classes(
            sinks.staged(t.county_map, "map"), log=True
        ),
        # by income group
        "effective_rate": lambda t: t.rates,
        "rate_view": lambda t: income.rate_view(t.rates, RATE_YEARS[1]),
        # by state
        "neighbour_states": lambda t: t.neighbours,
        "neighbour_trend": lambda t: states.neighbour_trend(t.neighbours),
        "neighbour_trend_subset": lambda t: states.neighbour_trend(
            t.neighbours, ["Connecticut", "New Jersey", "Texas"]
        ),
        "states": lambda t: t.states,
        "state_share": lambda t: states.state_share_long(t.states, bounded=True),
        "state_share_both": lambda t: states.state_share_long(
            t.states, ["percLiability", "percAGI"], bounded=True
        ),
        "resident_share": lambda t: states.resident_share(t.states),
        "other_states_mean": lambda t: states.other_states_mean(states.resident_share(t.states)),
        "state_totals": lambda t: states.state_totals(t.only(YEAR).neighbours, YEAR),
        "legacy_state_groups": lambda t: states.legacy_state_groups(t.v1, t.v2),
        "top_legacy_groups": lambda t: states.top_legacy_groups(
            states.legacy_state_groups(t.only(YEAR).v1, t.only(YEAR).v2), YEAR, 3
        ),
        "agi_definition_compare": lambda t: states.agi_definition_compare(t.v1, t.v2),
        "od_flows": lambda t: states.od_flows(
            t.only(YEAR).neighbours, state_centers(t.spark), YEAR
        ),
        # taxable sales
        "industry_totals": lambda t: sales.industry_totals(
            t.only(SALES_START).sales, JURISDICTION, SALES_YEAR
        ),
        "industry_totals_one": lambda t: sales.industry_totals(
            t.only(SALES_START).sales, JURISDICTION, SALES_YEAR, "4522"
        ),
        "top_industries": lambda t: sales.top_industries(
            t.only(SALES_START).sales, JURISDICTION, SALES_YEAR
        ),
        "top_sectors_kept": lambda t: sales.top_sectors(
            t.only(SALES_START).sales, t.sectors, JURISDICTION, SALES_YEAR
        ),
        "top_sectors_all": lambda t: sales.top_sectors(
            t.only(SALES_START).sales, t.sectors, JURISDICTION, SALES_YEAR, pct_of="all"
        ),
        "sector_descriptions": lambda t: sales.sector_descriptions(t.sales, t.sectors),
        "top_industry_by_county": lambda t: sales.top_industry_by_county(t.sales),
        "top_industry_map": lambda t: t.industry_map,
        "top_industry_map_year": lambda t: maps.one_year_map(t.only(SALES_START).industry_map, SALES_YEAR),
        "top_industry_map_complete": lambda t: maps.complete_regions(t.industry_map),
        "null_year_rows": lambda t: maps.unmatched_regions(t.industry_map),
        "quarter4_map": lambda t: maps.fourth_quarter_map(t.boundary, t.sales, bounded=True),
        "industry_share": lambda t: sales.industry_share(t.sales),
        "quarterly_series": lambda t: sales.quarterly_series(t.sales),
        "quarterly_series_4541": lambda t: sales.quarterly_series(t.sales, industry="4541"),
        "top_industries_q4": lambda t: sales.top_industries_q4(t.sales, t.sectors),
        "freq_description": lambda t: sales.sales_frequency(t.sales, "description"),
        "freq_industry": lambda t: sales.sales_frequency(t.sales, "naics_industry_group"),
        "freq_jurisdiction": lambda t: sales.sales_frequency(t.sales, "jurisdiction"),
        # checks
        "counties_per_year": lambda t: quality.counties_per_year(t.counties),
        "rows_per_county_year": lambda t: quality.rows_per_county_year(
            income.county_income_long(t.counties)
        ),
        "distinct_pairs": lambda t: quality.county_years(t.counties),
        "first_row_per_county": lambda t: quality.first_row_per_county(t.only(1996).counties, 1996),
        "keys_intersect": lambda t: quality.counties_in_both(t.only(1995, 1996).counties, 1996, 1995),
        "keys_missing": lambda t: quality.counties_missing_in(
            t.only(1995, 1996).counties, 1996, 1995
        ),
        "names_setdiff": lambda t: quality.boundaries_without_sales(t.boundary, t.sales),
        # dashboard
        "view_region": lambda t: views.region_view(t.regions, "AGI per returnee"),
        "view_share": lambda t: views.share_view(states.resident_share(t.states)),
        "view_states": lambda t: views.states_view(
            states.state_share_long(t.states, bounded=True),
            ["New Jersey", "Connecticut", "California", "Florida"],
        ),
        "view_industry": lambda t: views.industry_view(
            sales.industry_share(t.sales),
            "Electronic Shopping and Mail-Order Houses",
            ["Albany", "Erie", "Hamilton", "St. Lawrence"],
        ),
        "view_industry_percent": lambda t: views.industry_view(
            sales.industry_share(t.sales), "Department Stores", ["Albany", "Erie"], views.PERCENT
        ),
        "view_region_labels": lambda t: views.dollar_labels(
            views.region_view(t.regions, "Tax liability per returnee")
        ),
        "view_share_labels": lambda t: views.percent_labels(
            views.share_view(states.resident_share(t.states))
        ),
        "county_ranking_labels": lambda t: views.unit_labels(
            income.county_ranking(t.only(YEAR).counties, YEAR), AGI, "M"
        ),
        "quarterly_series_labels": lambda t: views.month_labels(
            sales.quarterly_series(t.sales, ["ALBANY", "ERIE"])
        ),
        "choices_variable": lambda t: views.variable_choices(t.regions),
        "choices_state": lambda t: views.state_choices(
            states.state_share_long(t.states, bounded=True)
        ),
        "choices_industry": lambda t: views.industry_choices(sales.industry_share(t.sales)),
        "choices_county": lambda t: views.county_choices(sales.industry_share(t.sales)),
        "publish_roundtrip": _publish_roundtrip,
    }
    for key, measure in MEASURE_KEYS.items():
        for plan, bounded in (("", True), ("_default", False)):  # the verbs' two plans
            q[f"county_top5_{key}{plan}"] = lambda t, m=measure, b=bounded: income.county_extremes(
                t.counties, m, YEAR, bounded=b
            )
            q[f"county_bottom5_{key}{plan}"] = (
                lambda t, m=measure, b=bounded: income.county_extremes(
                    t.counties, m, YEAR, largest=False, bounded=b
                )
            )
            q[f"measure_summary_{key}{plan}"] = lambda t, m=measure, b=bounded: (
                income.measure_summary(t.counties, m, bounded=b)
            )
            q[f"top_states_{key}{plan}"] = lambda t, m=measure, b=bounded: states.top_states(
                t.only(YEAR).neighbours, m, YEAR, 3, bounded=b
            )
    q["top_counties_each_year_default"] = lambda t: income.top_counties_each_year(t.counties)
    q["county_map_default"] = lambda t: maps.county_map(t.boundary, t.only(YEAR).counties, YEAR)
    q["quarter4_map_default"] = lambda t: maps.fourth_quarter_map(t.boundary, t.sales)
    q["view_states_ten"] = lambda t: views.states_view(
        states.state_share_long(t.states, bounded=True), TEN_STATES
    )
    q["arranged_counties"] = lambda t: arrange_desc(
        income.county_ranking(t.only(YEAR).counties, YEAR), AGI
    )
    q["quarterly_series_since"] = lambda t: sales.quarterly_series(t.sales).where(
        F.col("date") >= date_lit("1998-01-01")
    )
    q["json_pages"] = features.json_pages
    q["exports"] = _exports
    q["measure_summary_overall"] = lambda t: income.measure_summary(
        t.counties, LIABILITY, by_year=False, bounded=True
    )
    q["state_measure_summary"] = lambda t: income.measure_summary(
        t.neighbours, LIABILITY, bounded=True
    )
    return q


def queries() -> dict[str, Query]:
    def analysis(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            fit_shuffles(spark, order_tables.shuffled_bytes(spark, folder))
            return rounded(build(Tables(spark, folder)))

        return run

    def verb(build: Callable[[Reader], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            fit_shuffles(spark, order_tables.shuffled_bytes(spark, folder))
            return rounded(build(reader(spark, folder)))

        return run

    return {
        **{name: analysis(build) for name, build in _table_queries().items()},
        **{name: analysis(build) for name, (build, _) in features.TABLE_FEATURES.items()},
        **{name: verb(build) for name, (build, _) in VERBS.items()},
        **{name: verb(build) for name, (build, _) in features.VERB_FEATURES.items()},
    }
