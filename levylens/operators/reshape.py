from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from levylens.functions import paste
from levylens.functions._column import col


def pivot_longer(
    df: DataFrame,
    columns: Sequence[str],
    names_to: str = "variable",
    values_to: str = "value",
) -> DataFrame:
    """Wide to long, keeping missing values. Rows multiply inside their task: no shuffle.

    An unpivot of one column is a plain projection; the optimizer would not reduce it itself. The
    two new names must differ from those of the columns that stay.
    """
    ids = [c for c in df.columns if c not in columns]
    names = [c.lower() for c in [*ids, names_to, values_to]]
    if len(set(names)) < len(names):
        raise ValueError(f"{names_to} or {values_to} is the name of a column that stays")
    if len(columns) == 1:
        return df.select(
            *[col(c) for c in ids],
            F.lit(columns[0]).alias(names_to),
            col(columns[0]).alias(values_to),
        )
    return df.unpivot([col(c) for c in ids], [col(c) for c in columns], names_to, values_to)


def unite(df: DataFrame, name: str, parts: Sequence[str], sep: str = "_") -> DataFrame:
    """Glue columns into one at the place of the first and drop them; missing parts read NA."""
    joined = paste(*parts, sep=sep).alias(name)
    out = [joined if c == parts[0] else col(c) for c in df.columns if c not in parts[1:]]
    return df.select(*out)
