from __future__ import annotations

from pyspark.sql import Column, functions as F

from levylens.constants import MONTHS
from levylens.functions._column import ColumnLike, col


def month_no(c: ColumnLike) -> Column:
    """English month name to 1..12, NULL for any other text."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.nullif(F.array_position(names, col(c)), F.lit(0)).cast("int")


def year_month(c: ColumnLike) -> Column:
    """"2013/3" to the first day of that month, NULL when it cannot be read."""
    return F.try_to_date(col(c), "yyyy/M")


def date_lit(iso: str) -> Column:
    return F.lit(iso).cast("date")


def month_label(c: ColumnLike) -> Column:
    """Date to a short label such as "Mar-13"."""
    return F.date_format(col(c), "MMM-yy")
