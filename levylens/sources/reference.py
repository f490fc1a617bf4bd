"""Fixed reference tables.

They are inline relations of known size, so the optimizer broadcasts them without being told.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from levylens.constants import STATE_CENTERS


def literal(value: str | int | float | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else repr(value)


def values(rows: Sequence[tuple], columns: Sequence[str]) -> str:
    """An inline relation as SQL text."""
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def inline(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    return spark.sql(values(rows, columns))


def state_centers(spark: SparkSession) -> DataFrame:
    """state_name, x (longitude), y (latitude) of the fifty states."""
    return inline(spark, STATE_CENTERS, ["state_name", "x", "y"])
