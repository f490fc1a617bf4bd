"""Descriptions of hierarchical codes: the deepest level that describes a code wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from levylens.functions import ltrim_ws
from levylens.functions._column import col, unused
from levylens.operators.joins import null_safe_join
from levylens.sources.sinks import staged

LENGTHS = (6, 5, 4, 3, 2)


def expanded_ranges(levels: DataFrame, code: str) -> DataFrame:
    """Codes written as a range ("31-33") as one row per code in it; other codes stay. A range runs
    over codes of the length of its ends; one that runs backwards or between lengths has none."""
    text = ltrim_ws(F.rtrim(col(code)))
    ends = F.split(text, r"\s*[-\u2013]\s*")
    first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    is_range = text.rlike(r"^\d+\s*[-\u2013]\s*\d+$")
    low, high = first.try_cast("int"), last.try_cast("int")
    fits = is_range & (F.length(first) == F.length(last)) & (low <= high)
    size = F.length(first)
    run = F.transform(F.sequence(low, F.greatest(low, high)), lambda x: F.lpad(x.cast("string"), size, "0"))
    none = F.array().cast("array<string>")
    codes = F.when(fits, run).when(is_range, none).otherwise(F.array(text))
    (name,) = unused(levels.columns, "expanded")
    out = levels.withColumn(name, F.explode(codes))
    return out.select(*[col(name).alias(c) if c == code else col(c) for c in levels.columns])


def nearest_level(
    df: DataFrame,
    code: str,
    levels: DataFrame,
    level_code: str,
    description: str,
    lengths: Sequence[int] = LENGTHS,
) -> DataFrame:
    """`df` with `description` and `<description>_level`: those of the longest code of `levels`
    that the row's code begins with, of one of the `lengths`; missing if there is none.

    Ranges in `levels` are expanded; of codes that occur twice the smallest description is taken.
    The codes in use are looked up once each, level by level by hash, and the result is joined back
    to the rows, by broadcast if its stored size allows, so the rows are read twice and not moved
    for it. A missing code has no description.
    """
    level = f"{description}_level"
    own = df.drop(*[c for c in df.columns if c.lower() in (description.lower(), level.lower())])
    table = expanded_ranges(levels, level_code).groupBy(col(level_code).alias("level_code"))
    table = table.agg(F.min(col(description)).alias("text"))
    found = own.select(col(code).alias("code")).where(col(code).isNotNull()).distinct()
    names = []
    for n in sorted(set(lengths), reverse=True):
        name = f"text_{n}"
        names.append((n, name))
        at = table.where(F.length("level_code") == n)
        at = at.select(F.col("level_code").alias(f"prefix_{n}"), F.col("text").alias(name))
        begins = (F.left("code", F.lit(n)) == F.col(f"prefix_{n}")) & (F.length("code") >= n)
        found = found.join(at, begins, "left")
    found = found.select(
        F.col("code").alias(code),
        F.coalesce(*[F.col(name) for _, name in names]).alias(description),
        F.coalesce(*[F.when(F.col(f"prefix_{n}").isNotNull(), F.lit(n)) for n, _ in names]).alias(level),
    )
    return null_safe_join(own, staged(found, "codes"), [code], "left")
