"""Table verbs: DataFrame in, DataFrame out.

Verbs that need more than one look at their input take `bounded`. With `bounded=True` the caller
states that the input is an aggregate whose size depends on the number of places, years or
industries, not on the number of source rows; a window over it is then the cheapest plan. The
default makes no such assumption: no partition ever holds a whole group or the whole table. Where
it needs something per group (totals, limits, brackets), that is worked out in a job of its own,
stored in the shared folder and joined back, by broadcast if its stored size allows.
"""

from levylens.operators.columns import (
    col_range, mutate, mutate_at, relocate, select_positions, set_names, transmute,
)
from levylens.operators.codes import expanded_ranges, nearest_level
from levylens.operators.joins import (
    anti_join, dimension_left_join, left_join, merge_inner, merge_left, null_safe_join, semi_join,
)
from levylens.operators.presence import Presence, presence
from levylens.operators.quantiles import (
    approximate_summary, exact_quantiles, exact_summary, merged_summaries, six_number_summary, store_summaries,
)
from levylens.operators.reshape import pivot_longer, unite
from levylens.operators.sets import bind_rows, intersect_keys, setdiff_keys
from levylens.operators.shares import column_percent, share, totals_row, with_total
from levylens.operators.summaries import (
    choices, count_rows, distinct_rows, first_per_key, frequency, summarise_at,
)
from levylens.operators.topn import arrange_desc, reorder_by_mean, slice_head, slice_max, slice_min

__all__ = [
    "Presence", "anti_join", "approximate_summary", "arrange_desc", "bind_rows", "choices", "col_range", "column_percent",
    "count_rows", "dimension_left_join", "distinct_rows", "exact_quantiles", "exact_summary", "expanded_ranges", "first_per_key",
    "frequency", "intersect_keys", "left_join", "merge_inner", "merge_left", "merged_summaries", "mutate",
    "mutate_at", "nearest_level", "null_safe_join", "pivot_longer", "presence", "relocate", "reorder_by_mean",
    "select_positions", "semi_join", "set_names", "setdiff_keys", "share",
    "six_number_summary", "slice_head", "slice_max", "slice_min", "store_summaries", "summarise_at", "totals_row",
    "transmute", "unite", "with_total",
]
