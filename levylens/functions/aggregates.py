"""Sums and means with an explicit rule for missing values, as aggregates or over a window."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

from levylens.functions._column import ColumnLike, col


def known(c: ColumnLike) -> Column:
    """The value, with NULL for NaN."""
    c = col(c)
    return F.when(~F.isnan(c.cast("double")), c)


def _over(aggregate: Column, over: WindowSpec | None) -> Column:
    return aggregate if over is None else aggregate.over(over)


def sum0(c: ColumnLike, over: WindowSpec | None = None) -> Column:
    """Sum that ignores missing values, NaN among them; a group without any value sums to 0.

    The sum keeps its own type: whole numbers stay whole.
    """
    return F.coalesce(_over(F.sum(known(c)), over), F.lit(0))


def _if_complete(c: Column, result: Column, over: WindowSpec | None) -> Column:
    complete = _over(F.count(c), over) == _over(F.count(F.lit(1)), over)
    return F.when(complete, _over(result, over))


def sum_strict(c: ColumnLike, over: WindowSpec | None = None) -> Column:
    """Sum that is NULL as soon as one value of the group is missing."""
    c = col(c)
    return _if_complete(c, F.sum(c), over)


def mean_strict(c: ColumnLike, over: WindowSpec | None = None) -> Column:
    """Mean that is NULL as soon as one value of the group is missing."""
    c = col(c)
    return _if_complete(c, F.avg(c), over)
