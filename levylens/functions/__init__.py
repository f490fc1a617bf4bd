"""Column helpers that give Spark expressions the missing-value and text rules of the source data.

All are built-in Spark expressions (no Python UDF), so they stay inside whole-stage codegen.
"""

from levylens.functions.aggregates import mean_strict, sum0, sum_strict
from levylens.functions.dates import date_lit, month_label, month_no, year_month
from levylens.functions.formats import (
    comma, dollar, percent_label, percent_text, rounded_text, unit_label,
)
from levylens.functions.logic import case_ordered, if_else_na, is_in, is_missing, not_in
from levylens.functions.numbers import log10, malformed, num, ratio, whole
from levylens.functions.text import ltrim_ws, paste, replace_first, title_case

__all__ = [
    "case_ordered", "comma", "date_lit", "dollar", "if_else_na", "is_in", "is_missing", "log10",
    "ltrim_ws", "malformed", "mean_strict", "month_label", "month_no", "not_in", "num", "paste",
    "percent_label", "percent_text", "ratio", "replace_first", "rounded_text", "sum0",
    "sum_strict", "title_case", "unit_label", "whole", "year_month",
]
