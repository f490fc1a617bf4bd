"""Warnings of a load: how many cells and pages could not be read, counted while the rows pass by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from levylens.functions import malformed, num
from levylens.functions._column import col, unused
from levylens.sources.readers import BROKEN_PAGE
from levylens.sources.sinks import staged


class Warnings:
    """Counts that are known once the watched rows have been used."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.names = [f"cell_{i}" for i in range(len(columns))]
        self.observation = Observation()

    @property
    def pages(self) -> int:
        """Pages (or lines) without a readable row. Waits for the first use of the rows."""
        return self.observation.get["pages"] or 0

    @property
    def cells(self) -> dict[str, int]:
        """Per column the cells that are there and are no numbers. Waits as `pages` does."""
        found = self.observation.get
        return {c: found[n] or 0 for c, n in zip(self.columns, self.names, strict=True)}

    def table(self, like: DataFrame) -> DataFrame:
        """(what, n): a row per column and one for the pages."""
        rows = [("pages", self.pages), *self.cells.items()]
        return like.sparkSession.createDataFrame(rows, "what string, n long")


def parsed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Warnings]:
    """The rows with these text columns as numbers, and the warnings that go with them.

    Rows that `open_data` has marked as broken pages are counted and dropped. Blank cells and the
    words for missing values give no warning. The counts are taken in the pass that reads the rows,
    before any later filter, which is therefore not moved below them. They are right once the rows
    are written by the tasks that read them (`parsed_and_stored`); a task that is repeated after
    its rows were shuffled counts twice.
    """
    warnings = Warnings(columns)
    counts = [
        F.count_if(malformed(c)).alias(n) for c, n in zip(columns, warnings.names, strict=True)
    ]
    marked = BROKEN_PAGE in df.columns
    pages = F.count_if(F.col(BROKEN_PAGE).isNotNull()) if marked else F.sum(F.lit(0))
    watched = df.observe(warnings.observation, pages.alias("pages"), *counts)
    if marked:
        watched = watched.where(F.col(BROKEN_PAGE).isNull()).drop(BROKEN_PAGE)
    return watched.withColumns({c: num(col(c)) for c in columns}), warnings


def parsed_and_stored(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Warnings]:
    """`parsed`, with the rows written to the shared folder and read back: the counts are known."""
    rows, warnings = parsed(df, columns)
    return staged(rows, "parsed"), warnings


def unreadable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cell, n): the cells behind the warnings, each spelling once, most frequent first."""
    kind, cell = unused(df.columns, "column", "cell")
    cells = F.array(*[F.struct(F.lit(c).alias(kind), col(c).alias(cell)) for c in columns])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").where(malformed(F.col(cell)))
    counted = rows.groupBy(kind, cell).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), kind, cell).toDF("column", "cell", "n")
