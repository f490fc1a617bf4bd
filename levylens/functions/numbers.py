from __future__ import annotations

from pyspark.sql import Column, functions as F

from levylens.functions._column import ColumnLike, col


def num(c: ColumnLike) -> Column:
    """Text to double; anything that is not a number becomes NULL instead of raising, NaN too.

    Spark reads a trailing Java type letter ("1d", "2F") as part of a number; here it is not one.
    """
    text = col(c)
    plain = ~F.right(text, F.lit(1)).isin("d", "D", "f", "F") | F.lower(F.right(text, F.lit(2))).isin("nf")
    return F.nanvl(F.when(plain, text).try_cast("double"), F.lit(None).cast("double"))


def malformed(c: ColumnLike) -> Column:
    """Whether a text that is there is not a number. Blank text and the words for missing values,
    NA and NaN, are not: they read as missing without a warning."""
    text = F.trim(col(c).cast("string"))
    return text.isNotNull() & ~text.isin("", "NA", "NaN") & num(col(c).cast("string")).isNull()


def whole(c: ColumnLike) -> Column:
    """Text to integer (years, quarters), NULL when malformed; "2004.0" is 2004."""
    value = num(col(c).cast("string"))
    return F.when(value == F.floor(value), value).try_cast("int")


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, with NULL for a zero denominator."""
    return F.try_divide(col(a), col(b))


def log10(c: ColumnLike) -> Column:
    """Base-10 logarithm, NULL for values that are not positive."""
    return F.log10(col(c))
