"""Single table verbs on the whole order-entry tables, each with its SQL.

Here nothing is known about the size of the input, so these run the verbs' default plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from levylens import operators as v
from levylens.functions import sum0, sum_strict
from levylens.sources import readers

Reader = Callable[[str], DataFrame]


def _long_prices(t: Reader) -> DataFrame:
    parts = t("part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice")
    return v.pivot_longer(parts, ["p_size", "p_retailprice"])


def _nation_customers(t: Reader) -> DataFrame:
    nations = t("nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    customers = t("customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    return v.dimension_left_join(nations, customers)


def _some_nan(t: Reader) -> DataFrame:
    price = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_extendedprice"))
    return t("lineitem").select("l_returnflag", price.alias("price"))


def _dotted(t: Reader) -> DataFrame:
    return t("orders").select(
        F.col("o_orderpriority").alias("priority.name"), F.col("o_totalprice").alias("total.price")
    )


def _order_keys(t: Reader, year: int) -> DataFrame:
    return t("orders").where(F.year("o_orderdate") == year).select("o_custkey")


def _lineitem_orders(t: Reader) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


_ORDER = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _columns(names: list[str]) -> str:
    return ", ".join(names)


VERBS: dict[str, tuple[Callable[[Reader], DataFrame], str]] = {
    "slice_max_orders": (
        lambda t: v.slice_max(
            t("orders").select(*_ORDER), "o_totalprice", 5, by=["o_orderpriority"]
        ),
        f"""SELECT {_columns(_ORDER)} FROM orders QUALIFY
            rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 5""",
    ),
    "slice_min_lineitem": (
        lambda t: v.slice_min(t("lineitem").select(*_LINE), "l_extendedprice", 20),
        f"""SELECT {_columns(_LINE)} FROM lineitem
            QUALIFY rank() OVER (ORDER BY l_extendedprice) <= 20""",
    ),
    "slice_head_orders": (
        lambda t: v.slice_head(
            t("orders").select(*_ORDER),
            2,
            [F.desc("o_totalprice"), F.asc("o_orderkey")],
            by=["o_custkey"],
        ),
        f"""SELECT {_columns(_ORDER)} FROM orders QUALIFY row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
    ),
    "share_orders": (
        lambda t: v.share(
            t("orders").select(*_ORDER), {"share": "o_totalprice"}, ["o_orderpriority"]
        ),
        f"""SELECT {_columns(_ORDER)}, round(o_totalprice
              / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 10) AS share
            FROM orders""",
    ),
    "column_percent_supplier": (
        lambda t: v.column_percent(t("supplier"), ["s_acctbal"]).select(
            "s_suppkey", F.col("s_acctbal").alias("share")
        ),
        """SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 10) AS share
           FROM supplier""",
    ),
    "six_numbers_lineitem": (
        lambda t: v.six_number_summary(t("lineitem"), "l_extendedprice", ["l_returnflag"]),
        """SELECT l_returnflag, min(l_extendedprice) AS "min",
             round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
             round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
             round(avg(l_extendedprice), 2) AS mean,
             round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, max(l_extendedprice) AS "max",
             count(*) - count(l_extendedprice) AS missing,
             round(sum(l_extendedprice), 2) AS total
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "six_numbers_all_lineitem": (
        lambda t: v.six_number_summary(_some_nan(t), "price"),
        """SELECT min(price) AS "min", round(quantile_cont(price, 0.25), 6) AS q1,
             round(quantile_cont(price, 0.5), 6) AS median, round(avg(price), 2) AS mean,
             round(quantile_cont(price, 0.75), 6) AS q3, max(price) AS "max",
             CAST(0 AS BIGINT) AS missing, CAST('NaN' AS DOUBLE) AS total
           FROM (SELECT l_extendedprice AS price FROM lineitem WHERE l_linenumber <> 7)""",
    ),
    "sums_without_nan_lineitem": (
        lambda t: _some_nan(t).groupBy("l_returnflag").agg(sum0("price").alias("total")),
        """SELECT l_returnflag, round(sum(l_extendedprice) FILTER (l_linenumber <> 7), 4) AS total
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "slice_max_without_nan_lineitem": (
        lambda t: v.slice_max(_some_nan(t), "price", 3, by=["l_returnflag"]),
        """SELECT l_returnflag, l_extendedprice AS price FROM lineitem WHERE l_linenumber <> 7
           QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) <= 3""",
    ),
    "slice_max_dotted_orders": (
        lambda t: v.slice_max(_dotted(t), "total.price", 4, by=["priority.name"]),
        """SELECT o_orderpriority AS "priority.name", o_totalprice AS "total.price" FROM orders
           QUALIFY rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 4""",
    ),
    "totals_row_large_nation": (
        lambda t: v.totals_row(
            t("nation").select(
                "n_name", (F.col("n_nationkey") + F.lit(9007199254740993)).alias("large")
            )
        ),
        """SELECT n_name, n_nationkey + 9007199254740993 AS large FROM nation
           UNION ALL SELECT 'Total', CAST(sum(n_nationkey + 9007199254740993) AS BIGINT)
           FROM nation""",
    ),
    "summarise_at_lineitem": (
        lambda t: v.summarise_at(t("lineitem"), ["l_linestatus"], _AMOUNTS, sum_strict, "_sum"),
        f"""SELECT l_linestatus, {_columns([f"round(sum({c}), 4) AS {c}_sum" for c in _AMOUNTS])}
            FROM lineitem GROUP BY l_linestatus""",
    ),
    "frequency_part": (
        lambda t: v.frequency(t("part"), "p_type"),
        """SELECT p_type AS "Var1", count(*) AS "Freq" FROM part GROUP BY p_type""",
    ),
    "totals_row_customer": (
        lambda t: v.totals_row(v.count_rows(t("customer"), ["c_mktsegment"])),
        """SELECT c_mktsegment, count(*) AS freq FROM customer GROUP BY c_mktsegment
           UNION ALL SELECT 'Total', count(*) FROM customer""",
    ),
    "first_per_key_orders": (
        lambda t: v.first_per_key(
            t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"]
        ),
        """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) = 1""",
    ),
    "distinct_rows_lineitem": (
        lambda t: v.distinct_rows(t("lineitem"), "l_suppkey", "l_returnflag"),
        "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    ),
    "reorder_by_mean_part": (
        lambda t: v.reorder_by_mean(t("part"), "p_type", "p_retailprice"),
        """SELECT p_type, round(avg(p_retailprice), 4) AS p_retailprice FROM part
           GROUP BY p_type""",
    ),
    "semi_join_customer": (
        lambda t: v.semi_join(
            t("customer").select("c_custkey", "c_mktsegment"),
            t("orders").withColumnRenamed("o_custkey", "c_custkey"),
            ["c_custkey"],
        ),
        """SELECT c_custkey, c_mktsegment FROM customer
           WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    ),
    "anti_join_orders": (
        lambda t: v.anti_join(t("orders").select(*_ORDER), _lineitem_orders(t), ["o_orderkey"]),
        f"""SELECT {_columns(_ORDER)} FROM orders
            WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    ),
    "dimension_left_join_nation": (
        _nation_customers,
        """SELECT n_nationkey AS nationkey, n_name, c_custkey
           FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey""",
    ),
    "merge_inner_supplier": (
        lambda t: v.merge_inner(
            t("supplier").select("s_suppkey", "s_nationkey"),
            t("nation").select("n_nationkey", "n_name"),
            "s_nationkey",
            "n_nationkey",
        ),
        """SELECT s_suppkey, s_nationkey, n_name
           FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "intersect_keys_orders": (
        lambda t: v.intersect_keys(_order_keys(t, 1996), _order_keys(t, 2001), "o_custkey"),
        """SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996
           INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001""",
    ),
    "setdiff_keys_orders": (
        lambda t: v.setdiff_keys(t("orders"), _lineitem_orders(t), "o_orderkey"),
        "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    ),
    "bind_rows_keys": (
        lambda t: v.bind_rows(
            t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")),
            t("supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")),
        ),
        """SELECT 'customer' AS kind, c_custkey AS k FROM customer
           UNION ALL SELECT 'supplier', s_suppkey FROM supplier""",
    ),
    "pivot_longer_part": (
        _long_prices,
        """SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
           UNION ALL SELECT p_partkey, 'p_retailprice', round(p_retailprice, 6) FROM part""",
    ),
    "unite_part": (
        lambda t: v.unite(
            t("part").select("p_partkey", "p_brand", "p_type"), "kind", ["p_brand", "p_type"], "/"
        ),
        "SELECT p_partkey, p_brand || '/' || p_type AS kind FROM part",
    ),
}


def reader(spark: SparkSession, folder: str) -> Reader:
    return lambda name: readers.table_again(spark, f"{folder}/{name}.parquet")
