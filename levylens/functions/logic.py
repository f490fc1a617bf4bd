from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from levylens.functions._column import ColumnLike, col


def is_in(c: ColumnLike, values: Iterable) -> Column:
    """Membership that is never NULL: a missing value is not a member."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def not_in(c: ColumnLike, values: Iterable) -> Column:
    """Negated membership; rows with a missing value are kept (SQL NOT IN would drop them)."""
    return ~is_in(c, values)


def is_missing(c: ColumnLike, numeric: bool = False) -> Column:
    """NULL, or in a floating-point column also NaN."""
    c = col(c)
    return c.isNull() | F.isnan(c) if numeric else c.isNull()


def if_else_na(test: Column, yes, no) -> Column:
    """Two-way choice whose result is NULL where the test is NULL."""
    return F.when(test, yes).when(~test, no)


def case_ordered(cases: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """First matching label and its position in case order; both NULL where nothing matches."""
    (condition, text), *rest = cases
    label, position = F.when(condition, text), F.when(condition, 1)
    for i, (condition, text) in enumerate(rest, start=2):
        label, position = label.when(condition, text), position.when(condition, i)
    return label, position
