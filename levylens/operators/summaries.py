from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from levylens.functions._column import col


def summarise_at(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    fn: Callable[[str], Column],
    suffix: str = "",
) -> DataFrame:
    """One aggregate applied to several columns per group."""
    return df.groupBy(*[col(k) for k in by]).agg(*[fn(c).alias(c + suffix) for c in columns])


def count_rows(df: DataFrame, by: Sequence[str], name: str = "freq") -> DataFrame:
    return df.groupBy(*[col(k) for k in by]).agg(F.count(F.lit(1)).alias(name))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Frequency table sorted by value; missing values are not counted."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("Var1"))
        .agg(F.count(F.lit(1)).alias("Freq"))
        .orderBy("Var1")
    )


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[col(c) for c in columns]).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One whole row per key: the smallest by the remaining columns, left to right, NULL first.

    Tables have no row order here, so "first" is fixed by value. As a minimum it is combined
    within each task before the shuffle, however often a key occurs.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[col(c) for c in rest])).alias("_first")
    grouped = df.groupBy(*[col(k) for k in keys]).agg(first)
    return grouped.select(
        *[col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns]
    )


def choices(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, for a pick-list."""
    return df.select(col(column)).distinct().orderBy(col(column))
