from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    """Accept a column or a literal column name; names with dots or spaces need no quoting."""
    return c if isinstance(c, Column) else F.col(quoted(c))


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
