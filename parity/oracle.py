"""The registered questions as DuckDB SQL on the order-entry tables.

Written from the meaning of each analysis, not from its Spark plan: NULL rules are spelled out
with IS DISTINCT FROM and counts, ties with RANK, quantiles with QUANTILE_CONT, and natural breaks
by trying every cut. The inline place tables are shared with the Spark side as data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from levylens import constants as c
from levylens.sources import order_tables as o
from levylens.sources.reference import literal, values
from parity.queries import (
    JURISDICTION, MEASURE_KEYS, RATE_YEARS, SALES_YEAR, TEN_STATES, YEAR,
)
from parity.features import TABLE_FEATURES, VERB_FEATURES
from parity.verbs import VERBS


def _list(items: Sequence) -> str:
    return "(" + ", ".join(map(literal, items)) + ")"


def _labels(items: Sequence) -> str:
    return "[" + ", ".join(map(literal, items)) + "]"


def _case(subject: str, pairs: Sequence[tuple], default: str) -> str:
    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in pairs)
    return f"CASE {subject} {whens} ELSE {default} END"


def _strict(x: str, over: str = "") -> str:
    return f"CASE WHEN count({x}){over} = count(*){over} THEN sum({x}){over} END"


def _group_case(rank: bool) -> str:
    whens = " ".join(
        f"WHEN income_class IN {_list(raw)} THEN {i if rank else literal(label)}"
        for i, (label, raw) in enumerate(c.INCOME_GROUPS, start=1)
    )
    return f"CASE {whens} END"


def _rank_classes() -> str:
    return "1" + "".join(
        f" + CAST(o_totalprice >= {bound} AS INTEGER)" for _, bound in o.INCOME_CLASSES[:-1]
    )


NUM = "TRY_CAST({} AS DOUBLE)".format
CLASS_LABELS = _labels(["Total", *[label for label, _ in o.INCOME_CLASSES]])
NY_KEYS = _list([key for key, state, _ in o.PLACES if state == "New York"])
STATE_NAMES = _list(c.STATE_NAMES)
STATE_TOTALS = _list(c.STATE_TOTAL_COUNTIES)
LEAD = r"regexp_replace({}, '^\s+', '')".format
TITLE = (
    "array_to_string(list_transform(string_split(lower(jurisdiction), ' '), "
    "lambda w: upper(w[1]) || w[2:]), ' ')"
)
MEASURES = ", ".join(c.MEASURES)
NY_AGI = "new_york_state_amount_of_ny_adjusted_gross_income"
FEDERAL_AGI = "federal_amount_of_ny_adjusted_gross_income"
RETURNS, AGI, LIABILITY = c.RETURNS, c.AGI, c.LIABILITY

# Each table expression may use the ones above it.
TABLES = {
    # ---- raw tables ------------------------------------------------------------------------------
    "v1_places": values(o.v1_places(), ["k", "state", "county"]),
    "v2_places": values(o.v2_places(), ["k", "state", "county", "residence"]),
    "sales_places": values(o.sales_places(), ["k", "jurisdiction"]),
    "boundary_names": values(
        [*o.boundary_names(), o.EXTRA_BOUNDARY], ["k", "geoid_text", "place_name"]
    ),
    "sectors": values(o.SECTORS, ["sector", "sector_description"]),
    "centers": values(c.STATE_CENTERS, ["state_name", "x", "y"]),
    "income_base": f"""
        SELECT year(o_orderdate) AS y, c_nationkey AS k, {_rank_classes()} AS cls,
               CAST(left(o_orderpriority, 1) AS INTEGER) AS rate,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_v1": f"""
        SELECT CAST(y AS VARCHAR) AS tax_year, state,
               CASE WHEN county = ' Greene' AND y = 1996 AND cls = 0 THEN ' Hamilton'
                    ELSE county END AS county,
               {CLASS_LABELS}[cls + 1] AS income_class,
               CAST(first_k AS VARCHAR) AS place_of_residence_sort_order,
               CASE WHEN county = ' St. Lawrence' AND y = 1997 AND cls = 0 THEN 'n/a'
                    ELSE CAST(n AS VARCHAR) END AS number_of_all_returns,
               CASE WHEN county = ' Greene' AND y = 1996 AND cls = 0 THEN '802099'
                    WHEN county = ' Hamilton' AND y = 1998 AND cls = 0 THEN 'n/a'
                    ELSE CAST(cents * CAST(0.00001 AS DECIMAL(6,5)) AS VARCHAR) END AS agi_k,
               CAST(rate_cents * CAST(0.0000001 AS DECIMAL(8,7)) AS VARCHAR) AS liability_k
        FROM (SELECT y, state, county, cls, count(*) AS n, min(k) AS first_k,
                     CAST(sum(cents) AS DECIMAL(28,0)) AS cents,
                     CAST(sum(cents * rate) AS DECIMAL(28,0)) AS rate_cents
              FROM (SELECT y, k, cls, rate, cents FROM income_base
                    UNION ALL SELECT y, k, 0, rate, cents FROM income_base) b
              JOIN v1_places USING (k)
              WHERE y < {o.FIRST_V2_YEAR}
              GROUP BY y, state, county, cls)""",
    "raw_v2": f"""
        SELECT CAST(y AS VARCHAR) AS tax_year, state, county, residence AS place_of_residence,
               status AS tax_liability_status, CAST(n AS VARCHAR) AS number_of_returns,
               CAST(cents * CAST(0.01 AS DECIMAL(3,2)) AS VARCHAR) AS {NY_AGI},
               CAST(cents * CAST(0.011 AS DECIMAL(4,3)) AS VARCHAR) AS {FEDERAL_AGI},
               CAST(rate_cents * CAST(0.0001 AS DECIMAL(5,4)) AS VARCHAR) AS tax_liability
        FROM (SELECT y, state, county, residence, count(*) AS n,
                     CAST(sum(cents) AS DECIMAL(28,0)) AS cents,
                     CAST(sum(cents * rate) AS DECIMAL(28,0)) AS rate_cents
              FROM income_base JOIN v2_places USING (k)
              WHERE y >= {o.FIRST_V2_YEAR}
              GROUP BY y, state, county, residence),
             (VALUES ('All Returns'), ('Taxable')) AS s(status)""",
    "sales_base": f"""
        SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 3) // 3 AS quarter, s_nationkey AS k,
               CAST(coalesce({_labels(o.BRAND_SECTORS)}[CAST(p_brand[7:] AS INTEGER)], 99) * 100
                    + {_case("p_type", o.TYPE_SUFFIXES, "99")} AS VARCHAR) AS naics,
               (CAST(round(l_extendedprice * 100) AS BIGINT)
                * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 50) // 100 AS cents
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "raw_sales": f"""
        SELECT jurisdiction, (quarter // 4) || ' - ' || (quarter // 4 + 1) AS sales_tax_year,
               CAST(quarter % 4 + 1 AS VARCHAR) AS sales_tax_quarter,
               {_labels([p for _, p in o.SELLING_PERIODS])}[quarter % 4 + 1] AS selling_period,
               naics AS naics_industry_group,
               {_case("naics", o.NAMED_INDUSTRIES, "'Industry group ' || naics")} AS description,
               CASE WHEN jurisdiction = 'HAMILTON' AND quarter % 4 = 3 THEN 'n/a'
                    ELSE CAST(CAST(sum(cents) AS DECIMAL(28,0)) * CAST(0.01 AS DECIMAL(3,2))
                              AS VARCHAR) END AS amount_text
        FROM sales_base JOIN sales_places USING (k)
        GROUP BY jurisdiction, quarter, naics""",
    "boundary": """
        SELECT geoid_text AS "GEOID", place_name AS county, 'POLYGON EMPTY -- ' || n_name AS geometry
        FROM nation JOIN boundary_names ON n_nationkey = k WHERE geoid_text LIKE '36%'""",
    # ---- income by county ------------------------------------------------------------------------
    "named_v1": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year, {NUM("agi_k")} AS agi_k,
               {NUM("liability_k")} AS liability_k, {NUM(RETURNS)} AS returns,
               replace({LEAD("county")}, 'New York City - ', '') AS place
        FROM raw_v1
        WHERE state = 'New York' AND income_class = 'Total'
          AND (county IS NULL OR county NOT IN {_list(c.V1_NOT_COUNTIES)})""",
    "income_v1": f"""
        SELECT tax_year,
               CASE WHEN place = 'Manhattan' THEN 'New York'
                    WHEN place = 'Hamilton' AND agi_k IS NULL THEN NULL
                    WHEN place = 'Hamilton' AND agi_k = {c.MISLABELLED_HAMILTON_AGI_K} THEN 'Greene'
                    ELSE place END AS county,
               agi_k * 1000 AS {AGI}, liability_k * 1000 AS {LIABILITY}, returns AS {RETURNS}
        FROM named_v1""",
    "income_v2": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year,
               CASE WHEN county = 'Manhattan' THEN 'New York' ELSE {LEAD("county")} END AS county,
               {NUM(NY_AGI)} AS {AGI}, {NUM("tax_liability")} AS {LIABILITY},
               {NUM("number_of_returns")} AS {RETURNS}
        FROM raw_v2
        WHERE state = 'New York' AND tax_liability_status = 'All Returns'
          AND (county IS NULL OR county NOT IN {_list(c.V2_NOT_COUNTIES)})""",
    "counties": "SELECT * FROM income_v1 UNION ALL SELECT * FROM income_v2",
    "counties_long": " UNION ALL ".join(
        f"SELECT tax_year, county, '{m}' AS variable, {m} AS value FROM counties"
        for m in c.MEASURES
    ),
    "region_sums": f"""
        SELECT tax_year, CASE WHEN county IN {_list(c.DOWNSTATE)} THEN 'Downstate'
                              ELSE 'Upstate' END AS region,
               {_strict(AGI)} AS agi, {_strict(LIABILITY)} AS liability, {_strict(RETURNS)} AS n
        FROM counties GROUP BY 1, 2""",
    "regions": """
        SELECT tax_year, region, 'AGI per returnee' AS variable, agi / nullif(n, 0) AS value
        FROM region_sums
        UNION ALL
        SELECT tax_year, region, 'Tax liability per returnee', liability / nullif(n, 0)
        FROM region_sums""",
    "rates": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year, {_group_case(False)} AS income_group,
               CAST({_group_case(True)} AS INTEGER) AS income_group_ord, 'taxRate' AS variable,
               coalesce(sum({NUM("liability_k")} * 1000), 0)
               / nullif(coalesce(sum({NUM("agi_k")} * 1000), 0), 0) AS value
        FROM raw_v1
        WHERE county IN {STATE_TOTALS} AND state = 'New York' AND income_class <> 'Total'
          AND CAST(tax_year AS INTEGER) BETWEEN {RATE_YEARS[0]} AND {RATE_YEARS[1]}
        GROUP BY 1, 2, 3""",
    "year_map": f"""
        SELECT "GEOID", b.county, geometry, tax_year, {MEASURES},
               {AGI} * 1e-6 AS ny_agi_of_all_returns_in_millions
        FROM boundary b LEFT JOIN (SELECT * FROM counties WHERE tax_year = {YEAR}) d
          ON b.county IS NOT DISTINCT FROM d.county""",
    # ---- income by state ---------------------------------------------------------------------------
    "neighbours": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year,
               CASE WHEN state IN {_list(c.NEIGHBOURS)} THEN state ELSE 'Other states' END AS new,
               state, {AGI}, {LIABILITY}, {RETURNS}
        FROM (SELECT tax_year, state, {NUM("agi_k")} * 1000 AS {AGI},
                     {NUM("liability_k")} * 1000 AS {LIABILITY}, {NUM(RETURNS)} AS {RETURNS}
              FROM raw_v1 WHERE income_class = 'Total'
              UNION ALL
              SELECT tax_year, state, {NUM(FEDERAL_AGI)}, {NUM("tax_liability")},
                     {NUM("number_of_returns")}
              FROM raw_v2 WHERE tax_liability_status = 'All Returns')
        WHERE state IN {STATE_NAMES} AND state <> 'New York'""",
    "state_rows": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year, state, {NUM("agi_k")} * 1000 AS {AGI},
               {NUM("liability_k")} * 1000 AS {LIABILITY}, {NUM(RETURNS)} AS {RETURNS}
        FROM raw_v1
        WHERE income_class = 'Total' AND county IN {STATE_TOTALS} AND state IN {STATE_NAMES}
        UNION ALL
        SELECT CAST(tax_year AS INTEGER), state, {NUM(FEDERAL_AGI)}, {NUM("tax_liability")},
               {NUM("number_of_returns")}
        FROM raw_v2
        WHERE tax_liability_status = 'All Returns' AND state IN {STATE_NAMES}
          AND place_of_residence IN {_list([*c.STATE_NAMES, "All Places"])}
          AND county IN ('All', 'All Places')""",
    "state_shares": f"""
        SELECT tax_year, state,
               {LIABILITY} / nullif({_strict(LIABILITY, " OVER (PARTITION BY tax_year)")}, 0) AS tax,
               {AGI} / nullif({_strict(AGI, " OVER (PARTITION BY tax_year)")}, 0) AS agi
        FROM state_rows""",
    "state_share": """
        SELECT tax_year, state, 'percLiability' AS variable, tax AS value FROM state_shares""",
    "category_sums": f"""
        SELECT tax_year, CASE WHEN state = 'New York' THEN 'New York' ELSE 'Other States' END
                 AS category, coalesce(sum({LIABILITY}), 0) AS s
        FROM state_rows GROUP BY 1, 2""",
    "resident": """
        SELECT tax_year, category, 'percLiability' AS variable,
               s / nullif(sum(s) OVER (PARTITION BY tax_year), 0) AS value
        FROM category_sums""",
    "legacy": f"""
        SELECT CAST(tax_year AS INTEGER) AS tax_year,
               CASE WHEN state IN {_list(c.LEGACY_STATES)} THEN state ELSE 'Other states' END AS new,
               coalesce(sum(r), 0) AS {RETURNS},
               coalesce(sum(a), 0) AS ny_agi_of_all_returns_in_thousands,
               coalesce(sum(l), 0) AS tax_liability_of_all_returns_in_thousands
        FROM (SELECT tax_year, state, {NUM(RETURNS)} AS r, {NUM("agi_k")} AS a,
                     {NUM("liability_k")} AS l
              FROM raw_v1 WHERE income_class <> 'Total'
              UNION ALL
              SELECT tax_year, state, {NUM("number_of_returns")}, {NUM(NY_AGI)} / 1000,
                     {NUM("tax_liability")} / 1000
              FROM raw_v2 WHERE tax_liability_status = 'All Returns')
        WHERE state IN {STATE_NAMES} GROUP BY 1, 2""",
    # ---- sales -------------------------------------------------------------------------------------
    "sales_counties": f"""
        SELECT * EXCLUDE (jurisdiction), {NUM("amount_text")} AS amount,
               CASE WHEN {TITLE} LIKE 'St %' THEN 'St. ' || substr({TITLE}, 4)
                    ELSE {TITLE} END AS county
        FROM raw_sales""",
    "industry_sums": f"""
        SELECT sales_tax_year, jurisdiction, naics_industry_group, description,
               coalesce(sum({NUM("amount_text")}), 0) AS total_rev
        FROM raw_sales GROUP BY ALL""",
    "sector_sums": f"""
        SELECT jurisdiction, sector_description,
               coalesce(sum({NUM("amount_text")}), 0) AS total_rev
        FROM raw_sales LEFT JOIN sectors ON CAST(left(naics_industry_group, 2) AS DOUBLE) = sector
        WHERE jurisdiction = '{JURISDICTION}' AND sales_tax_year = '{SALES_YEAR}' GROUP BY ALL""",
    "top_industry": """
        SELECT * FROM (SELECT sales_tax_year, county, naics_industry_group, description,
                              coalesce(sum(amount), 0) AS total_rev
                       FROM sales_counties GROUP BY ALL)
        QUALIFY rank() OVER (PARTITION BY sales_tax_year, county ORDER BY total_rev DESC) = 1""",
    "industry_map": f"""
        SELECT "GEOID", b.county, geometry, sales_tax_year, naics_industry_group,
               description AS "Industry", total_rev
        FROM boundary b LEFT JOIN top_industry t ON b.county IS NOT DISTINCT FROM t.county
        WHERE b.county IS NULL OR b.county NOT IN {_list(c.CITY_COUNTIES)}""",
    "industry_shares": """
        SELECT *, 100 * revenue / nullif(sum(revenue) OVER (PARTITION BY sales_tax_year, county), 0)
                  AS pct
        FROM (SELECT left(sales_tax_year, 4) AS sales_tax_year, county, naics_industry_group,
                     description, coalesce(sum(amount), 0) AS revenue
              FROM sales_counties GROUP BY ALL)""",
    "industry_share": f"""
        SELECT sales_tax_year, county, naics_industry_group, description, u.variable,
               CASE u.variable WHEN 'Revenue' THEN revenue ELSE pct END AS value
        FROM industry_shares, (VALUES ('Revenue'), ('Percent of total revenue')) AS u(variable)
        WHERE naics_industry_group IN {_list(c.WAYFAIR_INDUSTRIES)}""",
    "series": f"""
        SELECT jurisdiction,
               make_date(CAST(left(sales_tax_year, 4) AS INTEGER),
                         list_position({_labels(c.MONTHS)}, string_split(selling_period, ' ')[1]), 1)
                 AS date,
               sales_tax_quarter, string_split(selling_period, ' ')[1] AS selling_period,
               naics_industry_group, description,
               round({NUM("amount_text")}, 4) AS taxable_sales_and_purchases
        FROM raw_sales WHERE jurisdiction IN {_list(c.WAYFAIR_JURISDICTIONS)}""",
    # ---- checks ------------------------------------------------------------------------------------
    "first_rows": f"""
        SELECT * FROM counties WHERE {AGI} <> {c.MISLABELLED_HAMILTON_AGI_K * 1000}
        QUALIFY row_number() OVER (
          PARTITION BY tax_year, county
          ORDER BY {AGI} NULLS FIRST, {LIABILITY} NULLS FIRST, {RETURNS} NULLS FIRST) = 1""",
}


def _statement(final: str) -> str:
    """The final SELECT with the table expressions it needs, directly or not."""
    needed: set[str] = set()
    text = final
    for name in reversed(TABLES):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + TABLES[name]
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in TABLES.items() if n in needed)
    return f"WITH {ctes}\n{final}"


def _round(columns: str, digits: int) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in columns.split(", "))


R4 = _round(MEASURES, 4)
V6 = "round(value, 6) AS value"
COUNTY_ROWS = f"SELECT tax_year, county, {R4} FROM"


def _extremes(measure: str, direction: str) -> str:
    return f"""
        SELECT tax_year, county, {R4} FROM counties d
        WHERE EXISTS (SELECT 1 FROM (SELECT county FROM counties
                                     WHERE tax_year = {YEAR} AND {measure} IS NOT NULL
                                     QUALIFY rank() OVER (ORDER BY {measure} {direction}) <= 5) t
                      WHERE t.county IS NOT DISTINCT FROM d.county)"""


def _summary(measure: str, table: str, by: str = "tax_year") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")

    def quantile(p: float) -> str:
        return f"round(quantile_cont({measure}, {p}), 6)"

    return f"""
        SELECT {key}round(min({measure}), 6) AS "min", {quantile(0.25)} AS q1,
               {quantile(0.5)} AS median, round(avg({measure}), 2) AS mean,
               {quantile(0.75)} AS q3, round(max({measure}), 6) AS "max",
               count(*) - count({measure}) AS missing,
               round({_strict(measure)}, 2) AS total
        FROM {table}{group}"""


def _classes(value: str, k: int = 5) -> str:
    """Every way to cut the sorted values into k classes; the one with the least deviation wins."""
    cuts = [f"p{i}" for i in range(1, k)]
    froms = ", ".join(f"pts {p}" for p in cuts)
    order = " AND ".join(f"{a}.i < {b}.i" for a, b in zip(cuts, cuts[1:], strict=False))
    joins, parts = "", []
    bounds = ["c0", *cuts, "ce"]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        parts.append(f"s{n}.dev")
        joins += f" JOIN spans s{n} ON s{n}.a = {a}_i AND s{n}.b = {b}_i"
    picked = ", ".join(f"{p}.i AS {p}_i, {p}.v AS {p}_v" for p in cuts)
    above = " + ".join(f"CAST(m.v > best.{p}_v AS INTEGER)" for p in cuts)
    return f""",
        valued AS (SELECT *, {value} AS v FROM year_map),
        counted AS (SELECT v, count(*) AS n FROM valued WHERE v IS NOT NULL GROUP BY v),
        pts AS (SELECT v, n, row_number() OVER (ORDER BY v) AS i FROM counted),
        ends AS (SELECT 0 AS i UNION ALL SELECT i FROM pts),
        spans AS (SELECT a.i AS a, b.i AS b,
                         sum(p.n * p.v * p.v) - sum(p.n * p.v) * sum(p.n * p.v) / sum(p.n) AS dev
                  FROM ends a JOIN ends b ON a.i < b.i JOIN pts p ON p.i > a.i AND p.i <= b.i
                  GROUP BY a.i, b.i),
        cuts AS (SELECT 0 AS c0_i, (SELECT max(i) FROM pts) AS ce_i, {picked}
                 FROM {froms} WHERE {order}),
        best AS (SELECT cuts.* FROM cuts{joins} ORDER BY {" + ".join(parts)} LIMIT 1)
        SELECT "GEOID", m.county, geometry, tax_year, {R4},
               round(ny_agi_of_all_returns_in_millions, 4) AS ny_agi_of_all_returns_in_millions,
               CAST(CASE WHEN m.v IS NOT NULL THEN 1 + {above} END AS INTEGER) AS class
        FROM valued m, best"""


def _percent_table(source: str, label: str, name: str) -> str:
    """Top ten with the percentage of all rows."""
    return f"""
        SELECT jurisdiction AS "Jurisdiction", {label} AS "{name}",
               printf('%.2f%%', round(100 * total_rev / all_rev, 2)) AS "Total Revenue"
        FROM (SELECT *, sum(total_rev) OVER () AS all_rev FROM {source})
        QUALIFY rank() OVER (ORDER BY total_rev DESC) <= 10"""


def _kept_table(source: str, label: str, name: str) -> str:
    """Top ten with the percentage of the ten."""
    return f"""
        SELECT jurisdiction AS "Jurisdiction", {label} AS "{name}",
               printf('%.2f%%', round(100 * total_rev / sum(total_rev) OVER (), 2))
                 AS "Total Revenue"
        FROM (SELECT * FROM {source} QUALIFY rank() OVER (ORDER BY total_rev DESC) <= 10)"""


ONE_JURISDICTION = (
    f"(SELECT * FROM industry_sums WHERE jurisdiction = '{JURISDICTION}'"
    f" AND sales_tax_year = '{SALES_YEAR}')"
)
MAP_COLUMNS = 'county, geometry, sales_tax_year, naics_industry_group, "Industry"'
SERIES_COLUMNS = (
    "jurisdiction, date, sales_tax_quarter, selling_period, naics_industry_group, description,"
    " taxable_sales_and_purchases"
)


def oracle_sql() -> dict[str, str]:
    year_rows = f"SELECT * FROM neighbours WHERE tax_year = {YEAR}"
    sql = {
        "region_per_return": f"SELECT tax_year, region, variable, {V6} FROM regions",
        "county_income_v1": f"{COUNTY_ROWS} income_v1",
        "county_income_v2": f"{COUNTY_ROWS} income_v2",
        "county_income": f"{COUNTY_ROWS} counties",
        "county_income_long": f"SELECT tax_year, county, variable, {V6} FROM counties_long",
        "county_ranking": f"SELECT county, round({AGI}, 4) AS {AGI} FROM counties"
        f" WHERE tax_year = {YEAR}",
        "top_counties_each_year": f"""{COUNTY_ROWS} (
            SELECT * FROM counties WHERE {RETURNS} IS NOT NULL
            QUALIFY rank() OVER (PARTITION BY tax_year ORDER BY {RETURNS} DESC) <= 5)""",
        "county_map": f"""
            SELECT "GEOID", county, geometry, tax_year, {R4},
                   round(ny_agi_of_all_returns_in_millions, 4) AS ny_agi_of_all_returns_in_millions
            FROM year_map""",
        "effective_rate": f"""
            SELECT tax_year, income_group, income_group_ord, variable, {V6} FROM rates""",
        "rate_view": f"""
            SELECT tax_year, income_group, income_group_ord, variable, {V6},
                   round(avg(value) OVER (), 6) AS mean_value,
                   'The average share for all income' || chr(10) || 'groups was '
                   || printf('%.2f', avg(value) OVER () * 100) || ' percent in {RATE_YEARS[1]}'
                     AS caption
            FROM rates WHERE tax_year = {RATE_YEARS[1]}""",
        "neighbour_states": f"SELECT tax_year, new, state, {R4} FROM neighbours",
        "neighbour_trend": f"""
            SELECT tax_year, new AS "State", round({_strict(LIABILITY)}, 4) AS "sum"
            FROM neighbours GROUP BY tax_year, new""",
        "neighbour_trend_subset": f"""
            SELECT tax_year, new AS "State", round({_strict(LIABILITY)}, 4) AS "sum"
            FROM neighbours WHERE state IN ('Connecticut', 'New Jersey', 'Texas')
            GROUP BY tax_year, new""",
        "states": f"SELECT tax_year, state, {R4} FROM state_rows",
        "state_share": f"SELECT tax_year, state, variable, {V6} FROM state_share",
        "state_share_both": f"""
            SELECT tax_year, state, variable, {V6} FROM (
              SELECT * FROM state_share
              UNION ALL SELECT tax_year, state, 'percAGI', agi FROM state_shares)""",
        "resident_share": f"SELECT tax_year, category, variable, {V6} FROM resident",
        "other_states_mean": """
            SELECT round(avg(value), 6) AS mean_value FROM resident
            WHERE category = 'Other States'""",
        "state_totals": f"""
            SELECT CAST(tax_year AS VARCHAR) AS tax_year, new, state, {R4} FROM ({year_rows})
            UNION ALL
            SELECT 'Total', '-', '-', {", ".join(f"round(sum({m}), 4)" for m in c.MEASURES)}
            FROM ({year_rows})""",
        "legacy_state_groups": f"""
            SELECT tax_year, new, {_round(
                RETURNS + ", ny_agi_of_all_returns_in_thousands,"
                " tax_liability_of_all_returns_in_thousands", 2)}
            FROM legacy""",
        "top_legacy_groups": f"""
            SELECT tax_year, new, {_round(
                RETURNS + ", ny_agi_of_all_returns_in_thousands,"
                " tax_liability_of_all_returns_in_thousands", 2)}
            FROM (SELECT * FROM legacy WHERE tax_year = {YEAR} AND new <> 'New York'
                  QUALIFY rank() OVER (ORDER BY {RETURNS} DESC) <= 3)""",
        "agi_definition_compare": f"""
            SELECT tax_year, variable, round(coalesce(sum(value), 0), 2) AS total FROM (
              SELECT CAST(tax_year AS INTEGER) AS tax_year, 'ny_agi_of_all_returns' AS variable,
                     {NUM("agi_k")} * 1000 AS value
              FROM raw_v1
              WHERE income_class = 'Total' AND county IN {STATE_TOTALS}
                AND state IN {STATE_NAMES} AND state <> 'New York'
              UNION ALL
              SELECT CAST(tax_year AS INTEGER), u.variable,
                     CASE u.variable WHEN '{NY_AGI}' THEN {NUM(NY_AGI)}
                                     ELSE {NUM(FEDERAL_AGI)} END
              FROM raw_v2, (VALUES ('{NY_AGI}'), ('{FEDERAL_AGI}')) AS u(variable)
              WHERE tax_liability_status = 'All Returns' AND county IN ('All', 'All Places')
                AND place_of_residence IN {_list([*c.STATE_NAMES, "All Places"])}
                AND state IN {STATE_NAMES} AND state <> 'New York')
            GROUP BY tax_year, variable""",
        "od_flows": f"""
            SELECT state, o.x AS origin_x, o.y AS origin_y, d.x AS destination_x,
                   d.y AS destination_y, round({LIABILITY}, 4) AS {LIABILITY},
                   round(log10({LIABILITY}), 6) AS width,
                   state || ', ' || format('{{:,}}', CAST(round_even({LIABILITY}, 0) AS BIGINT))
                     AS tooltip
            FROM neighbours JOIN centers o ON state = o.state_name
            JOIN centers d ON d.state_name = 'New York'
            WHERE tax_year = {YEAR} AND state NOT IN {_list(c.NOT_CONTIGUOUS)}""",
        "industry_totals": f"""
            SELECT sales_tax_year, jurisdiction, naics_industry_group, description,
                   round(total_rev, 4) AS total_rev
            FROM {ONE_JURISDICTION}""",
        "industry_totals_one": f"""
            SELECT sales_tax_year, jurisdiction, naics_industry_group, description,
                   round(total_rev, 4) AS total_rev
            FROM industry_sums
            WHERE jurisdiction = '{JURISDICTION}' AND sales_tax_year = '{SALES_YEAR}'
              AND naics_industry_group = '4522'""",
        "top_industries": _kept_table(ONE_JURISDICTION, "description", "Industry"),
        "top_sectors_kept": _kept_table("sector_sums", "sector_description", "Sector"),
        "top_sectors_all": _percent_table("sector_sums", "sector_description", "Sector"),
        "sector_descriptions": """
            SELECT DISTINCT CAST(left(naics_industry_group, 2) AS DOUBLE) AS sector,
                   sector_description
            FROM raw_sales LEFT JOIN sectors s
              ON CAST(left(naics_industry_group, 2) AS DOUBLE) = s.sector""",
        "top_industry_by_county": """
            SELECT sales_tax_year, county, naics_industry_group, description,
                   round(total_rev, 4) AS total_rev
            FROM top_industry""",
        "top_industry_map": f"""
            SELECT "GEOID", {MAP_COLUMNS}, round(total_rev, 4) AS total_rev FROM industry_map""",
        "top_industry_map_year": f"""
            SELECT {MAP_COLUMNS}, round(total_rev, 4) AS total_rev FROM industry_map
            WHERE sales_tax_year = '{SALES_YEAR}'""",
        "top_industry_map_complete": f"""
            SELECT "GEOID", {MAP_COLUMNS}, round(total_rev, 4) AS total_rev FROM industry_map
            WHERE "GEOID" IS NOT NULL AND county IS NOT NULL AND geometry IS NOT NULL
              AND sales_tax_year IS NOT NULL AND naics_industry_group IS NOT NULL
              AND "Industry" IS NOT NULL AND total_rev IS NOT NULL""",
        "null_year_rows": f"""
            SELECT "GEOID", {MAP_COLUMNS}, round(total_rev, 4) AS total_rev FROM industry_map
            WHERE sales_tax_year IS NULL""",
        "quarter4_map": """
            SELECT "GEOID", b.county, geometry, sales_tax_year, sales_tax_quarter, selling_period,
                   naics_industry_group, description,
                   round(amount, 4) AS taxable_sales_and_purchases
            FROM boundary b JOIN sales_counties s ON b.county = s.county
              OR (b.county IS NULL AND s.county IS NULL)
            WHERE sales_tax_quarter = '4'""",
        "industry_share": f"""
            SELECT sales_tax_year, county, naics_industry_group, description, variable, {V6}
            FROM industry_share""",
        "quarterly_series": f"SELECT {SERIES_COLUMNS} FROM series",
        "quarterly_series_4541": f"""
            SELECT {SERIES_COLUMNS} FROM series WHERE naics_industry_group = '4541'""",
        "top_industries_q4": f"""
            SELECT sales_tax_year, naics_industry_group, round(total, 2) AS total
            FROM (SELECT sales_tax_year, naics_industry_group, coalesce(sum(amount), 0) AS total
                  FROM sales_counties
                  WHERE sales_tax_quarter = '4'
                    AND (county IS NULL OR county NOT IN {_list(c.SALES_ROLLUPS)})
                  GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY sales_tax_year
                                       ORDER BY total DESC, naics_industry_group) <= 5""",
        "counties_per_year": "SELECT tax_year, count(*) AS freq FROM counties GROUP BY tax_year",
        "rows_per_county_year": """
            SELECT county, tax_year, count(*) AS freq FROM counties_long GROUP BY ALL""",
        "distinct_pairs": "SELECT DISTINCT tax_year, county FROM counties",
        "first_row_per_county": f"{COUNTY_ROWS} first_rows WHERE tax_year = 1996",
        "keys_intersect": """
            SELECT county FROM first_rows WHERE tax_year = 1996
            INTERSECT SELECT county FROM first_rows WHERE tax_year = 1995""",
        "keys_missing": f"""
            {COUNTY_ROWS} first_rows f
            WHERE tax_year = 1995
              AND NOT EXISTS (SELECT 1 FROM first_rows g WHERE g.tax_year = 1996
                              AND g.county IS NOT DISTINCT FROM f.county)""",
        "names_setdiff": "SELECT county FROM boundary EXCEPT SELECT county FROM sales_counties",
        "view_region": f"""
            SELECT tax_year, region, variable, {V6} FROM regions
            WHERE variable = 'AGI per returnee'""",
        "view_share": f"SELECT tax_year, category, variable, {V6} FROM resident",
        "view_states": f"""
            SELECT tax_year, state, variable, {V6} FROM state_share
            WHERE state IN ('New Jersey', 'Connecticut', 'California', 'Florida')""",
        "view_industry": f"""
            SELECT sales_tax_year, county, naics_industry_group, description, variable, {V6}
            FROM industry_share
            WHERE variable = 'Revenue' AND description = 'Electronic Shopping and Mail-Order Houses'
              AND county IN ('Albany', 'Erie', 'Hamilton', 'St. Lawrence')""",
        "view_industry_percent": f"""
            SELECT sales_tax_year, county, naics_industry_group, description, variable, {V6}
            FROM industry_share
            WHERE variable = 'Percent of total revenue' AND description = 'Department Stores'
              AND county IN ('Albany', 'Erie')""",
        "view_region_labels": f"""
            SELECT tax_year, region, variable, {V6},
                   '$' || format('{{:,}}', CAST(round(value) AS BIGINT)) AS label
            FROM regions WHERE variable = 'Tax liability per returnee'""",
        "view_share_labels": f"""
            SELECT tax_year, category, variable, {V6},
                   CAST(round_even(100 * value, 0) AS INTEGER) || '%' AS label
            FROM resident""",
        "county_ranking_labels": f"""
            SELECT county, round({AGI}, 4) AS {AGI},
                   format('{{:,.1f}}', {AGI} / 1000000) || ' M' AS label
            FROM counties WHERE tax_year = {YEAR}""",
        "quarterly_series_labels": f"""
            SELECT {SERIES_COLUMNS}, strftime(date, '%b-%y') AS "month"
            FROM series WHERE jurisdiction IN ('ALBANY', 'ERIE')""",
        "choices_variable": "SELECT DISTINCT variable FROM regions",
        "choices_state": "SELECT DISTINCT state FROM state_rows",
        "choices_industry": "SELECT DISTINCT description FROM industry_share",
        "choices_county": "SELECT DISTINCT county FROM industry_share",
        "publish_roundtrip": f"""
            SELECT name, count(*) AS row_count, round(sum(value), 2) AS total FROM (
              SELECT 'region_per_return' AS name, value FROM regions
              UNION ALL SELECT 'csv', value FROM regions
              UNION ALL SELECT 'effective_rate', value FROM rates
              UNION ALL SELECT 'resident_share', value FROM resident
              UNION ALL SELECT 'state_share', value FROM state_share
              UNION ALL SELECT 'industry_share', value FROM industry_share
              UNION ALL SELECT 'sheet NY Counties', {RETURNS} FROM counties
              UNION ALL SELECT 'sheet States', {RETURNS} FROM state_rows)
            GROUP BY name""",
        "measure_summary_overall": _summary(LIABILITY, "counties", by=""),
        "state_measure_summary": _summary(LIABILITY, "neighbours"),
    }
    for name, column in (
        ("description", "description"),
        ("industry", "naics_industry_group"),
        ("jurisdiction", "jurisdiction"),
    ):
        sql[f"freq_{name}"] = f"""
            SELECT {column} AS "Var1", count(*) AS "Freq" FROM raw_sales
            WHERE {column} IS NOT NULL GROUP BY {column}"""
    for key, measure in MEASURE_KEYS.items():
        sql[f"county_top5_{key}"] = _extremes(measure, "DESC")
        sql[f"county_bottom5_{key}"] = _extremes(measure, "ASC")
        sql[f"measure_summary_{key}"] = _summary(measure, "counties")
        sql[f"top_states_{key}"] = f"""
            SELECT tax_year, new, state, {R4} FROM ({year_rows} AND {measure} IS NOT NULL
              QUALIFY rank() OVER (ORDER BY {measure} DESC) <= 3)"""
    for key in MEASURE_KEYS:
        for name in ("county_top5", "county_bottom5", "measure_summary", "top_states"):
            sql[f"{name}_{key}_default"] = sql[f"{name}_{key}"]
    for name in ("top_counties_each_year", "county_map", "quarter4_map"):
        sql[f"{name}_default"] = sql[name]
    sql["view_states_ten"] = f"""
        SELECT tax_year, state, variable, {V6} FROM state_share WHERE state IN {_list(TEN_STATES)}"""
    sql["arranged_counties"] = sql["county_ranking"]
    sql["quarterly_series_since"] = f"""
        SELECT {SERIES_COLUMNS} FROM series WHERE date >= DATE '1998-01-01'"""
    sql["json_pages"] = sql["industry_totals"]
    sql["exports"] = f"""
        SELECT name, count(*) AS row_count, round(sum(value), 2) AS total FROM (
          SELECT 'region_per_return' AS name, value FROM regions
          UNION ALL SELECT 'effective_rate', value FROM rates
          UNION ALL SELECT 'resident_share', value FROM resident
          UNION ALL SELECT 'state_share', value FROM state_share
          UNION ALL SELECT 'industry_share', value FROM industry_share
          UNION ALL SELECT 'county_income', {RETURNS} FROM counties)
        GROUP BY name"""
    statements = {name: _statement(text) for name, text in sql.items()}
    for name, value in (
        ("county_classes", AGI),
        ("county_classes_log", f"CASE WHEN {AGI} > 0 THEN log10({AGI}) END"),
    ):
        # The class search adds its own table expressions after the shared ones.
        prefix = _statement("SELECT * FROM year_map").rsplit("\nSELECT", 1)[0]
        statements[name] = prefix + _classes(value)
    statements.update({name: _statement(text) for name, (_, text) in TABLE_FEATURES.items()})
    statements.update({name: text for name, (_, text) in (VERBS | VERB_FEATURES).items()})
    return statements
