from __future__ import annotations

from pyspark.sql import Column, functions as F

from levylens.functions._column import ColumnLike, col

# Characters after which a new word starts even without a blank.
_WORD_BREAKS = r"([-/(&,+])"
_MARK = "\u0001"


def ltrim_ws(c: ColumnLike) -> Column:
    """Remove any leading white space (blanks, tabs, no-break spaces, ...)."""
    return F.regexp_replace(col(c), r"^\p{IsWhite_Space}+", "")


def replace_first(c: ColumnLike, pattern: str, replacement: str) -> Column:
    """Replace the first match of a regular expression; `regexp_replace` would replace all."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(c), rf"^((?s:.*?))(?:{pattern})", "$1" + literal)


def title_case(c: ColumnLike) -> Column:
    """Capitalise every word; hyphens, slashes and brackets separate words, apostrophes do not.

    `initcap` breaks words at blanks only, so a marked blank is slipped in after the other
    separators and taken out again.
    """
    marked = F.regexp_replace(col(c), _WORD_BREAKS, "$1" + _MARK + " ")
    return F.replace(F.initcap(marked), F.lit(_MARK + " "), F.lit(""))


def paste(*parts: ColumnLike, sep: str = "") -> Column:
    """Concatenate, writing a missing part as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])
