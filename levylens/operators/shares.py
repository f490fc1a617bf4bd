from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from levylens.functions import ratio, sum0, sum_strict
from levylens.functions._column import col, unused
from levylens.operators.joins import null_safe_join
from levylens.sources.sinks import staged


def share(
    df: DataFrame, shares: dict[str, str], by: Sequence[str], bounded: bool = False
) -> DataFrame:
    """Add, for each {new: measure}, the row's share of the measure's total in its group.

    A missing measure anywhere in the group makes the group's shares missing. Unless the input is
    bounded the totals are aggregated, stored and joined back, so a group of any size stays spread
    over many tasks; a window would bring each whole group (a tax year, say) into one.
    """
    if bounded:
        window = W.partitionBy(*[col(k) for k in by])
        return df.withColumns({n: ratio(m, sum_strict(m, over=window)) for n, m in shares.items()})
    names = unused([*df.columns, *shares], *[f"total_{i}" for i in range(len(shares))])
    totals = df.groupBy(*[col(k) for k in by]).agg(
        *[sum_strict(m).alias(t) for t, m in zip(names, shares.values(), strict=True)]
    )
    joined = null_safe_join(df, staged(totals, "totals"), by, "left")
    parts = zip(shares.items(), names, strict=True)
    return joined.withColumns({n: ratio(m, t) for (n, m), t in parts}).drop(*names)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def column_percent(
    df: DataFrame, columns: Sequence[str] | None = None, bounded: bool = False
) -> DataFrame:
    """Divide numeric columns by their total over the rows present, ignoring missing values.

    Unless the input is bounded, the totals are one scalar subquery: a row computed by a
    partial/final aggregate in one scan, with no join and no window over the whole table.
    """
    columns = _numeric(df) if columns is None else list(columns)
    if bounded:
        totals = {c: sum0(c, over=W.partitionBy(F.lit(True))) for c in columns}
    else:
        named = {c: f"total_{i}" for i, c in enumerate(columns)}
        row = df.agg(F.struct(*[sum0(c).alias(n) for c, n in named.items()])).scalar()
        totals = {c: row[n] for c, n in named.items()}
    return df.withColumns({c: ratio(c, total) for c, total in totals.items()})


def with_total(
    df: DataFrame, by: Sequence[str], sums: dict[str, Column], label: str = "Total", fill: str = "-"
) -> DataFrame:
    """Sums or counts per group and, in a last row, over all groups: one pass over the rows.

    The groups are aggregated first, each task combining its own rows; only they are grouped again,
    by themselves and all together. `label` stands in the first key of the total, `fill` in others
    that are text.
    """
    groups = df.groupBy(*[col(k) for k in by]).agg(*[c.alias(n) for n, c in sums.items()])
    return totals_row(groups, label, fill, bounded=True)


def _totals_in_one_pass(df: DataFrame, label: str, fill: str) -> DataFrame:
    first = df.columns[0]
    numeric = [c for c in _numeric(df) if c != first]
    row, level = unused(df.columns, "row", "level")
    keys = [F.col(row), *[col(c) for c in df.columns if c not in numeric]]
    total = F.grouping_id() > 0
    cells = [
        F.when(total, sum0(c)).otherwise(F.any_value(col(c))).alias(c) for c in numeric
    ]
    out = df.withColumn(row, F.monotonically_increasing_id())
    out = out.groupingSets([keys, []], *keys).agg(F.grouping_id().alias(level), *cells)

    def cell(name: str) -> Column:
        if name in numeric:
            return col(name)
        text, in_total = col(name), F.lit(label if name == first else fill)
        own = text.cast("string") if name == first else text
        return F.when(F.col(level) > 0, in_total).otherwise(own).alias(name)

    return out.orderBy(level, row).select(*[cell(c) for c in df.columns])


def totals_row(
    df: DataFrame, label: str = "Total", fill: str = "-", bounded: bool = False
) -> DataFrame:
    """Append a row of column totals: label in the first column, `fill` in other text columns.

    The first column becomes text when it is not, since it has to hold the label. A column of
    totals has the type of its sum. The default computes the input twice, for its rows and for
    their sums. A bounded input is computed once, its rows and their total being two grouping sets;
    without rows it then has no total either.
    """
    if bounded:
        return _totals_in_one_pass(df, label, fill)
    first = df.columns[0]
    numeric = [c for c in _numeric(df) if c != first]
    sums = df.agg(*[sum0(c).alias(c) for c in numeric])

    def cell(name: str) -> Column:
        if name == first:
            return F.lit(label).alias(name)
        return col(name) if name in numeric else F.lit(fill).alias(name)

    body = df.withColumn(first, col(first).cast("string"))
    return body.unionByName(sums.select(*[cell(c) for c in df.columns]))
