"""Number-to-text formats used in report tables and labels. A missing number, NaN among them, has no
text: the result is NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from levylens.functions._column import ColumnLike, col
from levylens.functions.aggregates import known


def _printed(pattern: str, number: Column) -> Column:
    """`format_string` would print NULL as the word."""
    return F.when(known(number).isNotNull(), F.format_string(pattern, number))


def rounded_text(c: ColumnLike, digits: int = 2) -> Column:
    """Round half to even and keep the trailing zeros."""
    return _printed(f"%.{digits}f", F.bround(col(c), digits))


def percent_text(share: ColumnLike, digits: int = 2) -> Column:
    """0.125 to "12.50%", rounding half up."""
    return _printed(f"%.{digits}f%%", F.round(col(share) * 100, digits))


def percent_label(share: ColumnLike) -> Column:
    """0.125 to "12%", rounding half to even."""
    return _printed("%.0f%%", F.bround(col(share) * 100, 0))


def comma(c: ColumnLike, digits: int = 0) -> Column:
    """Thousands separators."""
    return F.format_number(known(c), digits)


def dollar(c: ColumnLike, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), comma(c, digits))


# Suffix and scale of the axis units.
UNITS = {"B": 1e-9, "M": 1e-6, "T": 1e-3}


def unit_label(c: ColumnLike, unit: str, digits: int = 1) -> Column:
    """1.5e9 with unit "B" to "1.5 B"."""
    return F.concat(comma(col(c) * UNITS[unit], digits), F.lit(f" {unit}"))
