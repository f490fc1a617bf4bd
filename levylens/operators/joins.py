"""Joins in which a missing key matches a missing key.

No broadcast hint is given anywhere. Spark broadcasts a side whose size it knows to be below
`spark.sql.autoBroadcastJoinThreshold`, from file statistics when planning or from the real bytes
at run time, and otherwise sorts and merges both sides, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from levylens.functions._column import col, quoted, unused


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on same-named keys; the result has the keys of the left side once."""
    renamed = dict(zip(keys, unused([*left.columns, *right.columns], *keys), strict=True))
    right = right.select(*[col(c).alias(renamed.get(c, c)) for c in right.columns])
    condition = reduce(
        lambda a, b: a & b,
        [left[quoted(k)].eqNullSafe(right[quoted(new)]) for k, new in renamed.items()],
    )
    return left.join(right, condition, how).drop(*renamed.values())


def left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left outer join on all columns the two sides have in common."""
    return null_safe_join(left, right, _common(left, right), "left")


def _common(left: DataFrame, right: DataFrame) -> list[str]:
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables have no column in common")
    return keys


def dimension_left_join(dimension: DataFrame, facts: DataFrame, bounded: bool = False) -> DataFrame:
    """`left_join(dimension, facts)` for a small left side and a large right side.

    A left outer join can neither broadcast its left side nor split a hot key of its right side,
    so all rows of a busy region would meet in one task. Stated as matched rows plus regions
    without any, the facts stay where they are when the dimension is small enough to broadcast,
    and only their distinct keys (combined within each task first) are shuffled.
    """
    if bounded:
        return left_join(dimension, facts)
    keys = _common(dimension, facts)
    matched = null_safe_join(dimension, facts, keys, "inner")
    present = facts.select(*[col(k) for k in keys]).distinct()
    unmatched = anti_join(dimension, present, keys)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def merge_left(facts: DataFrame, dimension: DataFrame, by: str) -> DataFrame:
    """Left outer join on one key, key column first."""
    joined = null_safe_join(facts, dimension, [by], "left")
    return joined.select(col(by), *[col(c) for c in joined.columns if c != by])


def merge_inner(left: DataFrame, right: DataFrame, by_left: str, by_right: str) -> DataFrame:
    """Inner join on differently named keys; the key of the left side remains."""
    condition = left[f"`{by_left}`"].eqNullSafe(right[f"`{by_right}`"])
    return left.join(right, condition, "inner").drop(right[f"`{by_right}`"])


def semi_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table.

    Equal keys of the other table are combined within each task before they are shuffled, so a
    key that fills it is one row per task. The same holds for `anti_join`.
    """
    return null_safe_join(df, _distinct_keys(other, keys), keys, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return null_safe_join(df, _distinct_keys(other, keys), keys, "left_anti")


def _distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[col(k) for k in keys]).distinct()
