from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from levylens.functions._column import col


def col_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from `first` to `last`, by position."""
    names = df.columns
    start, end = names.index(first), names.index(last)
    if start > end:
        raise ValueError(f"{first!r} comes after {last!r}")
    return names[start : end + 1]


def select_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Projection by 1-based column position."""
    names = df.columns
    return df.select(*[col(names[p - 1]) for p in positions])


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def mutate(df: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """Add or replace columns one after the other, each seeing the result of the earlier ones.

    A single `select` or `withColumns` would read the *old* value of a column that is assigned
    twice. The optimizer merges the steps into one projection.
    """
    for name, expression in steps:
        df = df.withColumn(name, expression)
    return df


def mutate_at(df: DataFrame, names: Sequence[str], fn: Callable[[str], Column]) -> DataFrame:
    """Apply one function to several columns in place."""
    return df.withColumns({name: fn(name) for name in names})


def transmute(df: DataFrame, by: Sequence[str], **expressions: Column) -> DataFrame:
    """Keep the grouping keys and the computed columns only."""
    return df.select(*[col(k) for k in by], *[e.alias(n) for n, e in expressions.items()])


def relocate(
    df: DataFrame, name: str, before: str | None = None, after: str | None = None
) -> DataFrame:
    """Move a column next to another one."""
    if (before is None) == (after is None):
        raise ValueError("give exactly one of before and after")
    names = [c for c in df.columns if c != name]
    at = names.index(before) if before is not None else names.index(after) + 1
    names.insert(at, name)
    return df.select(*[col(c) for c in names])
