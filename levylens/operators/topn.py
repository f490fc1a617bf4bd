"""Top and bottom rows. `slice_max` and `slice_min` keep ties, `slice_head` cuts them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import FractionalType

from levylens.functions._column import col, unused
from levylens.functions.aggregates import known
from levylens.operators.joins import null_safe_join
from levylens.sources.sinks import staged


def slice_max(
    df: DataFrame, measure: str, n: int, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Rows with the n largest values, per group if `by` is given; all ties of the n-th stay.

    The measure is of any type with an order: numbers, dates, text. Rows without a value never
    qualify. See `_slice` for the two plans.
    """
    return _slice(df, measure, n, by, bounded, largest=True)


def slice_min(
    df: DataFrame, measure: str, n: int, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Rows with the n smallest values; otherwise as `slice_max`."""
    return _slice(df, measure, n, by, bounded, largest=False)


def _slice(
    df: DataFrame, measure: str, n: int, by: Sequence[str], bounded: bool, largest: bool
) -> DataFrame:
    """Bounded input: rank within the group. Otherwise: keep what reaches the n-th value.

    A row ranks within n exactly if it reaches the n-th value counted with repeats. Each task
    passes on the n best values of a group, without the other columns; once the n-th is known the
    rows are filtered where they are, however many of them tie. The measure is read twice, so in
    the unbounded form it must be a value of the row, not a floating-point sum whose last bit may
    change when recomputed. NaN counts as missing.
    """
    value = col(measure)
    present = df.where(_present(df, measure).isNotNull())
    order = value.desc() if largest else value.asc()
    keys = [col(k) for k in by]
    row, limit_name = unused(df.columns, "row", "limit")
    if bounded:
        rank = F.rank().over(W.partitionBy(*(keys or [F.lit(True)])).orderBy(order))
        return present.withColumn(row, rank).where(F.col(row) <= n).drop(row)

    def reaches(limit: Column) -> Column:
        return value >= limit if largest else value <= limit

    last = F.min if largest else F.max
    if not by:
        limit = present.select(value).orderBy(order).limit(n).agg(last(value))
        return present.where(reaches(limit.scalar()))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    best = present.select(*keys, value).withColumn(row, nth).where(F.col(row) <= n)
    limits = best.groupBy(*keys).agg(last(value).alias(limit_name))
    joined = null_safe_join(present, staged(limits, "limits"), by, "inner")
    return joined.where(reaches(F.col(limit_name))).drop(limit_name)


def _present(df: DataFrame, measure: str) -> Column:
    """The measure, with NULL for NaN where its type has one."""
    kind = df.select(col(measure)).schema[0].dataType
    return known(measure) if isinstance(kind, FractionalType) else col(measure)


def slice_head(
    df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()
) -> DataFrame:
    """First n rows per group in the given order, ties cut.

    `order` should end in a tie-break. Each task passes on at most n rows per group.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    (name,) = unused(df.columns, "row")
    row = F.row_number().over(W.partitionBy(*[col(k) for k in by]).orderBy(*order))
    return df.withColumn(name, row).where(F.col(name) <= n).drop(name)


def arrange_desc(df: DataFrame, measure: str) -> DataFrame:
    """Largest first, missing values last, NaN among them."""
    return df.orderBy(_present(df, measure).desc_nulls_last())


def reorder_by_mean(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Categories in ascending order of the mean of a measure."""
    means = df.groupBy(col(category)).agg(F.avg(col(measure)).alias(measure))
    return means.orderBy(col(measure).asc_nulls_last(), col(category))
