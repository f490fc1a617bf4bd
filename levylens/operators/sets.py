from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from levylens.functions._column import col


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; differing names or types are an error."""

    def stack(a: DataFrame, b: DataFrame) -> DataFrame:
        if set(a.columns) != set(b.columns):
            raise ValueError(f"column names differ: {sorted(set(a.columns) ^ set(b.columns))}")
        types_a, types_b = dict(a.dtypes), dict(b.dtypes)
        differing = [c for c in a.columns if types_a[c] != types_b[c]]
        if differing:
            raise ValueError(f"column types differ: {differing}")
        return a.unionByName(b)

    return reduce(stack, tables)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both tables."""
    return a.select(col(key)).distinct().intersect(b.select(col(key)).distinct())


def setdiff_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table that the second lacks."""
    return a.select(col(key)).distinct().subtract(b.select(col(key)).distinct())
