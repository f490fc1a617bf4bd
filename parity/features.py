"""Queries that store something on the way (pages, layouts, bitmaps, sketches, snapshots), or that
meet planted cases, each with its SQL.

What `TABLE_FEATURES` reads are the derived tables, and its SQL may use the oracle's table
expressions; `VERB_FEATURES` reads the order-entry tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from levylens import operators as v
from levylens.constants import AGI, LIABILITY, RETURNS
from levylens.functions import percent_label, percent_text, rounded_text
from levylens.plans import income, maps, publish, quality, sales, states, views
from levylens.sources import order_tables, readers, schemas, sinks, snapshots, warnings

AMOUNT = sales.AMOUNT
ALL_PLACES = "NY STATE"
BROKEN = '[{"jurisdiction": "ERIE", '
V1_NUMBERS = [RETURNS, income.V1_AGI_K, income.V1_LIABILITY_K]
DESCRIBED = "Electronic Shopping and Mail-Order Houses"

# --- fixed values: sectors as published, some as ranges, and deeper levels of a few ---------------
CODE_LEVELS = [
    ("11", "Agriculture"), ("21", "Mining"), ("22", "Utilities"), ("23", "Construction"),
    ("31-33", "Manufacturing"), ("42", "Wholesale Trade"), ("44-45", "Retail Trade"),
    ("48 - 49", "Transportation"), ("51", "Information"), ("454", "Nonstore Retailers"),
    ("4541", "Electronic Shopping"), ("45411", "Mail-Order Houses"), ("452211", "Department Stores"),
]


def _pages(t) -> DataFrame:
    """All sales as the portal's pages, one of them broken, read back with that one marked."""
    root = sinks.shared_folder(t.spark, "pages")
    sinks.save_pages(t.sales, root)
    t.spark.createDataFrame([(BROKEN,)], "value string").write.mode("append").text(root)
    return readers.open_data(t.spark, root, schemas.SALES, mark_broken=True)


def json_pages(t) -> DataFrame:
    rows, _ = warnings.parsed(_pages(t), [AMOUNT])
    return sales.industry_totals(rows, ALL_PLACES, "1999 - 2000")


def _page_warnings(t) -> DataFrame:
    numbers = [AMOUNT, "sales_tax_quarter", "naics_industry_group"]
    rows, found = warnings.parsed_and_stored(_pages(t), numbers)
    return found.table(rows)


def _rebuilt_years(t, year: int = 2000) -> DataFrame:
    """All years written with a wrong amount in one of them, which is then written again."""
    path = sinks.shared_folder(t.spark, "counties")
    wrong = F.when(F.col("tax_year") == year, F.col(AGI) + 1).otherwise(F.col(AGI))
    publish.add_years(t.counties.withColumn(AGI, wrong), path)
    publish.add_years(t.only(year).counties, path)
    return readers.table(t.spark, path)


def _second_bundle(t) -> DataFrame:
    """A bundle of all counties, then one of a single year: reader of the first, reader of the
    second, and what a reader finds who asks now."""
    root = sinks.shared_folder(t.spark, "bundles")
    counties = sinks.staged(t.counties, "counties")

    def write(table: DataFrame) -> Callable[[str], None]:
        return lambda folder: sinks.save_bundle({"counties": table}, folder)

    found = {}
    snapshots.publish(t.spark, root, write(counties))
    found["first"] = snapshots.opened(t.spark, root, ["counties"])["counties"]
    snapshots.publish(t.spark, root, write(counties.where("tax_year = 2000")))
    found["second"] = snapshots.opened(t.spark, root, ["counties"])["counties"]
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("reader"), "row_count")
        for name, df in found.items()
    ]
    return rows[0].unionByName(rows[1])


def _clustered(t, table: DataFrame, name: str) -> DataFrame:
    path = sinks.shared_folder(t.spark, name)
    by = publish.PICKED_BY[name]
    sinks.save_clustered(table, path, by, bloom=by[:1])
    return readers.table(t.spark, path)


def _state_view(t) -> DataFrame:
    table = _clustered(t, states.state_share_long(t.states, bounded=True), "state_share")
    return views.states_view(table, ["New Jersey", "Connecticut", "California", "Florida"])


def _industry_view(t) -> DataFrame:
    table = _clustered(t, sales.industry_share(t.sales), "industry_share")
    return views.industry_view(table, DESCRIBED, ["Albany", "Erie", "Hamilton", "St. Lawrence"])


def _bucketed(t, table: DataFrame, name: str, by: list[str], buckets: int = 8) -> DataFrame:
    path = sinks.shared_folder(t.spark, name)
    catalog = path.rsplit("/", 1)[1].replace("-", "_")
    sinks.save_bucketed(table, catalog, by, buckets, path)
    return t.spark.table(catalog)


def _sales_per_return(t) -> DataFrame:
    by = ["tax_year", "county"]
    counties = _bucketed(t, t.counties, "counties", by)
    amounts = sales.clean_counties(t.sales).withColumn("tax_year", F.left("sales_tax_year", F.lit(4)).cast("int"))
    return maps.sales_per_return(counties, _bucketed(t, amounts, "sales", by))


def _coverage(t):
    """The counties of all years but the misfiled amount, as bitmaps."""
    return quality.coverage(t.counties)


def _names_without_sales(t) -> DataFrame:
    return quality.names_only_in_first(t.boundary.select("county"), sales.county_names(t.sales))


def _summary_store(t) -> tuple[DataFrame, DataFrame]:
    """Stored by year and county: first all years but one, then that one."""
    counties = sinks.staged(t.counties, "counties")
    path = sinks.shared_folder(t.spark, "summaries")
    late = F.col("tax_year") == 2000
    for rows in (counties.where(~late), counties.where(late)):
        v.store_summaries(rows, LIABILITY, ["tax_year", "county"], path)
    return counties, readers.table(t.spark, path)


def _merged_summary(t, by: list[str]) -> DataFrame:
    rows, store = _summary_store(t)
    return v.exact_summary(rows, LIABILITY, store, by)


_SUMMARY = """round(min({0}), 6) AS "min", round(quantile_cont({0}, 0.25), 6) AS q1,
    round(quantile_cont({0}, 0.5), 6) AS median, round(avg({0}), 2) AS mean,
    round(quantile_cont({0}, 0.75), 6) AS q3, round(max({0}), 6) AS "max",
    count(*) - count({0}) AS missing,
    round(CASE WHEN count({0}) = count(*) THEN sum({0}) END, 2) AS total""".format
_COUNTY_ROW = f"tax_year, county, round({AGI}, 4) AS {AGI}, round({LIABILITY}, 4) AS {LIABILITY}, {RETURNS}"
_PLAUSIBLE = "(SELECT * FROM counties WHERE agi_of_all_returns <> 802099000)"



def _classes_by_year(k: int = 5) -> str:
    """Every way to cut the sorted values of a year into k classes; the least deviation wins."""
    cuts = [f"p{i}" for i in range(1, k)]
    bounds = ["c0", *cuts, "ce"]
    spans = "".join(
        f" JOIN spans s{n} ON s{n}.tax_year = c.tax_year AND s{n}.a = {a} AND s{n}.b = {b}"
        for n, (a, b) in enumerate(zip(bounds, bounds[1:]))
    )
    ordered = "points p1" + "".join(
        f" JOIN points {b} ON {b}.tax_year = p1.tax_year AND {b}.i > {a}.i" for a, b in zip(cuts, cuts[1:])
    )
    picked = ", ".join(f"{p}.i AS {p}, {p}.v AS {p}_v" for p in cuts)
    above = " + ".join(f"CAST(m.v > {p}_v AS INTEGER)" for p in cuts)
    return f"""
        SELECT m.tax_year, county, round(v, 4) AS {AGI},
          CAST(CASE WHEN v IS NOT NULL THEN 1 + {above} END AS INTEGER) AS class
        FROM (SELECT tax_year, county, {AGI} AS v FROM counties WHERE tax_year < 1998) m JOIN (
          WITH points AS (SELECT tax_year, v, n, row_number() OVER (PARTITION BY tax_year ORDER BY v) AS i
            FROM (SELECT tax_year, {AGI} AS v, count(*) AS n FROM counties
                  WHERE tax_year < 1998 AND {AGI} IS NOT NULL GROUP BY ALL)),
          ends AS (SELECT tax_year, i FROM points UNION SELECT tax_year, 0 FROM points),
          spans AS (SELECT a.tax_year, a.i AS a, b.i AS b,
              sum(p.n * p.v * p.v) - sum(p.n * p.v) * sum(p.n * p.v) / sum(p.n) AS dev
            FROM ends a JOIN ends b ON a.tax_year = b.tax_year AND a.i < b.i
            JOIN points p ON p.tax_year = a.tax_year AND p.i > a.i AND p.i <= b.i GROUP BY ALL),
          cuts AS (SELECT p1.tax_year, 0 AS c0, {picked} FROM {ordered}),
          tops AS (SELECT tax_year, max(i) AS ce FROM points GROUP BY tax_year)
          SELECT c.*, ce FROM cuts c JOIN tops USING (tax_year){spans}
          QUALIFY row_number() OVER (PARTITION BY c.tax_year
            ORDER BY {" + ".join(f"s{n}.dev" for n in range(k))}) = 1
        ) best ON best.tax_year = m.tax_year"""


TABLE_FEATURES: dict[str, tuple[Callable, str]] = {
    "json_page_warnings": (
        _page_warnings,
        f"""SELECT 'pages' AS what, CAST(1 AS BIGINT) AS n
            UNION ALL SELECT '{AMOUNT}', count(*) FROM raw_sales WHERE amount_text = 'n/a'
            UNION ALL SELECT 'sales_tax_quarter', CAST(0 AS BIGINT)
            UNION ALL SELECT 'naics_industry_group', CAST(0 AS BIGINT)""",
    ),
    "unreadable_income": (
        lambda t: warnings.unreadable(t.v1, V1_NUMBERS),
        f"""SELECT "column", cell, count(*) AS n FROM (
              SELECT '{RETURNS}' AS "column", {RETURNS} AS cell FROM raw_v1
              UNION ALL SELECT '{income.V1_AGI_K}', agi_k FROM raw_v1
              UNION ALL SELECT '{income.V1_LIABILITY_K}', liability_k FROM raw_v1)
            WHERE cell = 'n/a' GROUP BY ALL""",
    ),
    "rebuilt_years": (_rebuilt_years, f"SELECT {_COUNTY_ROW} FROM counties"),
    "second_bundle": (
        _second_bundle,
        """SELECT 'first' AS reader, count(*) AS row_count FROM counties
           UNION ALL SELECT 'second', count(*) FROM counties WHERE tax_year = 2000""",
    ),
    "view_states_clustered": (
        _state_view,
        """SELECT tax_year, state, variable, round(value, 6) AS value FROM state_share
           WHERE state IN ('New Jersey', 'Connecticut', 'California', 'Florida')""",
    ),
    "view_industry_clustered": (
        _industry_view,
        f"""SELECT sales_tax_year, county, naics_industry_group, description, variable,
              round(value, 6) AS value
            FROM industry_share WHERE variable = 'Revenue' AND description = '{DESCRIBED}'
              AND county IN ('Albany', 'Erie', 'Hamilton', 'St. Lawrence')""",
    ),
    "sales_per_return": (
        lambda t: maps.sales_per_return(
            t.counties,
            sales.clean_counties(t.sales).withColumn("tax_year", F.left("sales_tax_year", F.lit(4)).cast("int")),
        ),
        f"""SELECT tax_year, county, round({RETURNS}, 4) AS {RETURNS}, round(amount, 4) AS total_rev,
              round(amount / nullif({RETURNS}, 0), 8) AS per_return
            FROM counties JOIN (
              SELECT CAST(sales_tax_year[:4] AS INTEGER) AS tax_year, county,
                coalesce(sum(amount), 0) AS amount
              FROM sales_counties GROUP BY 1, 2) USING (tax_year, county)""",
    ),
    "sales_per_return_bucketed": (_sales_per_return, ""),
    "county_classes_by_year": (
        lambda t: maps.county_classes_by_year(
            sinks.staged(t.counties, "counties").where("tax_year < 1998").select("tax_year", "county", AGI)
        ),
        _classes_by_year(),
    ),
    "coverage_counties_per_year": (
        lambda t: _coverage(t).key_counts("freq"),
        f"""SELECT tax_year, CAST(count(DISTINCT county) + max(CAST(county IS NULL AS INTEGER)) AS BIGINT) AS freq
            FROM {_PLAUSIBLE} GROUP BY tax_year""",
    ),
    "coverage_rows_per_year": (
        lambda t: _coverage(t).row_counts(),
        f"SELECT tax_year, count(*) AS freq FROM {_PLAUSIBLE} GROUP BY tax_year",
    ),
    "coverage_pairs": (
        lambda t: _coverage(t).pairs(),
        f"SELECT DISTINCT tax_year, county FROM {_PLAUSIBLE}",
    ),
    "coverage_in_both": (
        lambda t: _coverage(t).in_all(F.col("tax_year").isin(1995, 1996)),
        f"""SELECT county FROM {_PLAUSIBLE} WHERE tax_year = 1995
            INTERSECT SELECT county FROM {_PLAUSIBLE} WHERE tax_year = 1996""",
    ),
    "coverage_missing": (
        lambda t: _coverage(t).only_in(F.col("tax_year") == 1997, F.col("tax_year") == 1996),
        f"""SELECT county FROM {_PLAUSIBLE} WHERE tax_year = 1997
            EXCEPT SELECT county FROM {_PLAUSIBLE} WHERE tax_year = 1996""",
    ),
    "coverage_names": (
        _names_without_sales,
        "SELECT county FROM boundary EXCEPT SELECT county FROM sales_counties",
    ),
    "merged_summary_by_year": (
        lambda t: _merged_summary(t, ["tax_year"]),
        f"SELECT tax_year, {_SUMMARY(LIABILITY)} FROM counties GROUP BY tax_year",
    ),
    "merged_summary_by_county": (
        lambda t: _merged_summary(t, ["county"]),
        f"SELECT county, {_SUMMARY(LIABILITY)} FROM counties GROUP BY county",
    ),
    "merged_summary_overall": (
        lambda t: _merged_summary(t, []),
        f"SELECT {_SUMMARY(LIABILITY)} FROM counties",
    ),
}
TABLE_FEATURES["sales_per_return_bucketed"] = (_sales_per_return, TABLE_FEATURES["sales_per_return"][1])


def _planted_codes(t) -> DataFrame:
    """Industry codes of two to six digits from parts, some that no level describes."""
    part = t("part")
    brand = F.pmod(F.col("p_partkey"), F.lit(len(order_tables.BRAND_SECTORS))).cast("int")
    sector = F.get(F.array(*[F.lit(str(s)) for s in order_tables.BRAND_SECTORS]), brand)
    deep = F.get(F.array(F.lit("4541"), F.lit("45411"), F.lit("452211")), F.pmod("p_size", F.lit(3)))
    code = F.when(F.pmod("p_partkey", F.lit(7)) == 0, deep).otherwise(
        F.concat(sector, F.lit("4110"))
    )
    cut = F.left(code, F.pmod(F.col("p_size"), F.lit(5)) + 2)
    return part.select("p_partkey", F.when(F.pmod("p_partkey", F.lit(11)) != 0, cut).alias("code"))


def _described(t) -> DataFrame:
    levels = t("part").sparkSession.createDataFrame(CODE_LEVELS, "level string, text string")
    return v.nearest_level(_planted_codes(t), "code", levels, "level", "text")


_CODES = ", ".join(
    f"('{n}', '{text}')"
    for code, text in CODE_LEVELS
    for n in (
        [str(x) for x in range(int(code.split("-")[0]), int(code.split("-")[1]) + 1)] if "-" in code else [code]
    )
)
_SECTORS = "[" + ", ".join(f"'{s}'" for s in order_tables.BRAND_SECTORS) + "]"


def _plan_order(t) -> DataFrame:
    """The orders as CSV in order of their priority, which many share, read back."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = sinks.shared_folder(rows.sparkSession, "ordered")
    sinks.export_ordered(rows, path, [F.asc("o_orderpriority"), F.desc("o_totalprice")], files=6)
    return readers.dimension_csv(rows.sparkSession, path, rows.schema)


def _customer_years(t):
    return v.presence(
        t("orders").select("o_custkey", F.year("o_orderdate").alias("year")), ["o_custkey"], ["year"]
    )


def _late_flag(t) -> DataFrame:
    """Sketches of line items stored by flag and status, one flag added later, rolled up by flag."""
    rows = t("lineitem")
    path = sinks.shared_folder(rows.sparkSession, "summaries")
    late = F.col("l_returnflag") == "R"
    for part in (rows.where(~late), rows.where(late)):
        v.store_summaries(part, "l_extendedprice", ["l_returnflag", "l_linestatus"], path)
    store = readers.table(rows.sparkSession, path)
    return v.exact_summary(rows, "l_extendedprice", store, ["l_returnflag"])


def _some_null(t) -> DataFrame:
    size = F.col("p_size")
    share = F.when(size % 3 != 0, size / 64).when(size % 2 == 0, float("nan"))
    return t("part").select("p_partkey", share.alias("share"))


def _keyed(t) -> DataFrame:
    return t("orders").select("o_custkey", F.col("o_orderkey").alias("_key_o_custkey"))


VERB_FEATURES: dict[str, tuple[Callable, str]] = {
    "with_total_orders": (
        lambda t: v.with_total(
            t("orders"), ["o_orderpriority"],
            {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")},
        ),
        """SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) AS n,
             round(sum(o_totalprice), 2) AS total
           FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
    ),
    "totals_row_bounded_customer": (
        lambda t: v.totals_row(v.count_rows(t("customer"), ["c_mktsegment"]), bounded=True),
        """SELECT c_mktsegment, count(*) AS freq FROM customer GROUP BY c_mktsegment
           UNION ALL SELECT 'Total', count(*) FROM customer""",
    ),
    "code_levels_part": (
        _described,
        f"""WITH codes AS (
              SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN left(CASE WHEN p_partkey % 7 = 0
                THEN ['4541', '45411', '452211'][p_size % 3 + 1]
                ELSE {_SECTORS}[p_partkey % {len(order_tables.BRAND_SECTORS)} + 1] || '4110' END,
                p_size % 5 + 2) END AS code
              FROM part),
            levels(level, text) AS (VALUES {_CODES})
            SELECT p_partkey, code, arg_max(text, length(level)) AS text,
              CAST(max(length(level)) AS INTEGER) AS text_level
            FROM codes LEFT JOIN levels ON starts_with(code, level) GROUP BY p_partkey, code""",
    ),
    "ordered_export_orders": (
        _plan_order,
        "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM orders",
    ),
    "coverage_customers_both": (
        lambda t: _customer_years(t).in_all(F.col("year").isin(1996, 2001)),
        """SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996
           INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001""",
    ),
    "coverage_customers_lost": (
        lambda t: _customer_years(t).only_in(F.col("year") == 1996, F.col("year") == 1997),
        """SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996
           EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997""",
    ),
    "coverage_customers_any": (
        lambda t: _customer_years(t).in_any(F.col("year").isin(1996, 2001)),
        "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) IN (1996, 2001)",
    ),
    "merged_summary_lineitem": (
        _late_flag,
        f"SELECT l_returnflag, {_SUMMARY('l_extendedprice')} FROM lineitem GROUP BY l_returnflag",
    ),
    "formats_of_missing_part": (
        lambda t: _some_null(t).select(
            "p_partkey", rounded_text("share", 1).alias("rounded"), percent_text("share", 1).alias("percent"),
            percent_label("share").alias("label"),
        ),
        """SELECT p_partkey, printf('%.1f', round_even(s, 1)) AS rounded,
             printf('%.1f', round(s * 100, 1)) || '%' AS percent,
             CAST(round_even(s * 100, 0) AS INTEGER) || '%' AS label
           FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size / 64 END AS s FROM part)""",
    ),
    "slice_max_date_orders": (
        lambda t: v.slice_max(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", 3),
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
           QUALIFY rank() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC) <= 3""",
    ),
    "slice_min_text_part": (
        lambda t: v.slice_min(t("part").select("p_partkey", "p_brand", "p_type"), "p_type", 2, by=["p_brand"]),
        """SELECT p_partkey, p_brand, p_type FROM part
           QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_type) <= 2""",
    ),
    "semi_join_key_column_orders": (
        lambda t: v.semi_join(
            _keyed(t), t("customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"),
            ["o_custkey"],
        ),
        """SELECT o_custkey, o_orderkey AS _key_o_custkey FROM orders
           WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ),
    "arrange_with_nan_part": (
        lambda t: v.arrange_desc(_some_null(t), "share").select(
            "p_partkey", F.nanvl("share", F.lit(-1.0)).alias("share")
        ),
        """SELECT p_partkey, round(CASE WHEN p_size % 3 <> 0 THEN p_size / 64 WHEN p_size % 2 = 0 THEN -1 END, 10)
             AS share FROM part""",
    ),
}
