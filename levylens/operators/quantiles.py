"""Exact quantiles and the six-number summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levylens.functions._column import col, unused
from levylens.functions.aggregates import known, sum_strict
from levylens.operators.joins import null_safe_join
from levylens.sources import sinks
from levylens.sources.sinks import staged

QUARTILES = (0.25, 0.5, 0.75)

# A sketch of this size is wrong by about 4e-4 of a group's ranks; a bracket reaches four times as
# far to both sides and is cut into PARTS by value, one of which is sorted.
SKETCH_SIZE = 8000
HALF_WIDTH = 1.6e-3
WIDER = 16
PARTS = 1024
# Sketches are merged in two levels: those of the tasks of one of so many buckets, then the buckets'.
BUCKETS = 1024


def exact_quantiles(
    df: DataFrame,
    measure: str,
    probs: Sequence[float],
    by: Sequence[str],
    half_width: float = HALF_WIDTH,
) -> DataFrame:
    """Interpolated quantiles per group as columns q0, q1, ..., ignoring NULL and NaN. Runs jobs.

    `percentile` keeps every distinct value of a group in one task's memory. Here a first scan
    brackets each quantile between two values by sketches, which are merged in two levels. A second
    scan counts, within each task first, the rows below and between the brackets, and inside them
    by value. The counts then say in which part of a bracket a wanted rank lies, and only that
    part's values are sorted. Should a rank lie outside its bracket, all brackets are widened and
    the second scan is repeated, at last with brackets that hold everything.
    """
    scan = staged(_first_scan(df, measure, by), "scan")
    return _ranked(df, measure, probs, by, scan, half_width)


def _first_scan(df: DataFrame, measure: str, by: Sequence[str]) -> DataFrame:
    """Per group the keys, a sketch and the simple statistics, stored."""
    keys = [col(k) for k in by]
    value = known(measure).cast("double")
    bucket, *names = unused(
        by, "bucket", "sketch", "rows", "size", "low", "high", "sum", "whole", "missing"
    )
    sketch, n_rows, size, low, high, total, whole, missing = names
    parts = df.groupBy(*keys, (F.spark_partition_id() % BUCKETS).alias(bucket)).agg(
        F.kll_sketch_agg_double(value, SKETCH_SIZE).alias(sketch),
        F.count(F.lit(1)).alias(n_rows),
        F.count(value).alias(size),
        F.min(value).alias(low),
        F.max(value).alias(high),
        F.sum(value).alias(total),
        sum_strict(measure).alias(whole),
        F.count_if(col(measure).isNull()).alias(missing),
    )
    merged = parts.groupBy(*keys).agg(
        F.kll_merge_agg_double(sketch, SKETCH_SIZE).alias(sketch),
        F.sum(size).alias(size),
        F.min(low).alias(low),
        F.max(high).alias(high),
        F.sum(total).alias(total),
        sum_strict(whole).alias(whole),
        F.sum(missing).alias(missing),
    )
    fixed = ("sketch", "size", "low", "high", "sum", "whole", "missing")
    chosen = (sketch, size, low, high, total, whole, missing)
    renamed = [F.col(c).alias(f"stat_{n}") for c, n in zip(chosen, fixed, strict=True)]
    return merged.select(*[col(k).alias(f"key_{i}") for i, k in enumerate(by)], *renamed)


def _ranked(
    df: DataFrame,
    measure: str,
    probs: Sequence[float],
    by: Sequence[str],
    scan: DataFrame,
    half_width: float,
) -> DataFrame:
    keys = [f"key_{i}" for i in range(len(by))]
    value = F.col("value")
    values = df.select(
        *[col(k).alias(n) for k, n in zip(by, keys, strict=True)],
        known(measure).cast("double").alias("value"),
    ).where(value.isNotNull())
    groups = scan.where("stat_size > 0")
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(*_neighbours(p, F.col("stat_size"))) for p in probs]))
    )
    while True:
        brackets = staged(_brackets(groups, keys, probs, half_width), "brackets")
        counts = staged(_counts(values, brackets, keys, len(probs)), "counts")
        parts = counts.groupBy(*keys, "bin", "part").agg(F.sum("n").alias("n"))
        place = W.partitionBy(*keys).orderBy("bin", "part")
        parts = parts.withColumn("upto", F.sum("n").over(place))
        parts = parts.withColumn("before", F.col("upto") - F.col("n"))
        asked = groups.select(*keys, F.explode(ranks).alias("rank"))
        asked = null_safe_join(asked, parts, keys, "inner")
        asked = staged(asked.where("rank >= before and rank < upto"), "ranks")
        if asked.where("part is null").isEmpty():
            break
        half_width *= WIDER

    wanted = asked.groupBy(*keys, "bin", "part", "before").agg(
        F.collect_set("rank").alias("ranks")
    )
    running = F.sum("n").over(W.partitionBy(*keys, "bin", "part").orderBy("value"))
    picked = (
        null_safe_join(counts, wanted, [*keys, "bin", "part"], "inner")
        .withColumn("to", F.col("before") + running)
        .withColumn("rank", F.explode("ranks"))
        .where("rank < to and rank >= to - n")
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    )
    picked = null_safe_join(picked, groups.select(*keys, "stat_size"), keys, "inner")

    def interpolated(p: float) -> Column:
        low, high = (F.col("at")[rank] for rank in _neighbours(p, F.col("stat_size")))
        position = (F.col("stat_size") - 1) * F.lit(p)
        return low + (high - low) * (position - F.floor(position))

    return picked.select(
        *[F.col(n).alias(k) for k, n in zip(by, keys, strict=True)],
        *[interpolated(p).alias(f"q{i}") for i, p in enumerate(probs)],
    )


def _brackets(
    groups: DataFrame, keys: Sequence[str], probs: Sequence[float], half_width: float
) -> DataFrame:
    def edge(p: float) -> Column:
        if p <= 0:
            return F.col("stat_low")
        if p >= 1:
            return F.col("stat_high")
        return F.kll_sketch_get_quantile_double("stat_sketch", F.lit(p))

    edges = [(edge(p - half_width), edge(p + half_width)) for p in probs]
    flat = [e.alias(f"edge_{i}_{j}") for i, pair in enumerate(edges) for j, e in enumerate(pair)]
    return groups.select(*keys, *flat)


def _counts(values: DataFrame, brackets: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, bin, part, value, n): bins are the brackets and the gaps between them in ascending
    order; in a bracket rows are counted by part and value, in a gap together (part is null)."""
    value = F.col("value")
    lows, highs = ([F.col(f"edge_{i}_{j}") for i in range(n)] for j in (0, 1))
    inside = [value.between(low, high) for low, high in zip(lows, highs, strict=True)]
    steps = [value >= low for low in lows] + [value > high for high in highs]

    def part(low: Column, high: Column) -> Column:
        share = F.try_divide(value - low, high - low)
        return F.coalesce(F.floor(share * PARTS).cast("int"), F.lit(0))

    parts = F.coalesce(
        *[F.when(i, part(*e)) for i, e in zip(inside, zip(lows, highs, strict=True), strict=True)]
    )
    kept = reduce(Column.__or__, inside)
    return (
        null_safe_join(values, brackets, keys, "inner")
        .select(
            *keys,
            reduce(Column.__add__, [s.cast("int") for s in steps]).alias("bin"),
            parts.alias("part"),
            F.when(kept, value).alias("value"),
        )
        .groupBy(*keys, "bin", "part", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _neighbours(p: float, size: Column) -> tuple[Column, Column]:
    """0-based ranks between which the quantile lies."""
    position = (size - 1) * F.lit(p)
    return F.floor(position), F.ceil(position)


def six_number_summary(
    df: DataFrame, measure: str, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """min, q1, median, mean, q3, max, count of missing values and strict total per group.

    Unless the input is bounded the rows are read twice: for the simple numbers and the sketches,
    and for the counts of `exact_quantiles`.
    """
    if not by:
        (name,) = unused(df.columns, "all")
        one_group = df.withColumn(name, F.lit(0))
        return six_number_summary(one_group, measure, [name], bounded).drop(name)
    x = col(measure)
    if bounded:
        quartile = F.percentile(known(x), list(QUARTILES))
        return df.groupBy(*[col(k) for k in by]).agg(
            F.min(known(x)).alias("min"), quartile[0].alias("q1"), quartile[1].alias("median"),
            F.avg(known(x)).alias("mean"), quartile[2].alias("q3"), F.max(known(x)).alias("max"),
            F.count_if(x.isNull()).alias("missing"), sum_strict(x).alias("total"),
        )
    return _summary(df, measure, by, staged(_first_scan(df, measure, by), "scan"))


def _summary(df: DataFrame, measure: str, by: Sequence[str], scan: DataFrame) -> DataFrame:
    names = ["min", "q1", "median", "mean", "q3", "max", "missing", "total"]
    exact = _ranked(df, measure, QUARTILES, by, scan, HALF_WIDTH)
    simple = scan.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(by)],
        F.col("stat_low").alias("min"), F.col("stat_high").alias("max"),
        F.try_divide("stat_sum", "stat_size").alias("mean"),
        F.col("stat_missing").alias("missing"), F.col("stat_whole").alias("total"),
    )
    out = null_safe_join(simple, exact, by, "left").withColumnsRenamed(
        {"q0": "q1_", "q1": "median", "q2": "q3"}
    )
    return out.withColumnRenamed("q1_", "q1").select(*[col(k) for k in by], *names)


def store_summaries(df: DataFrame, measure: str, by: Sequence[str], path: str) -> None:
    """Write what summaries of a measure can be merged from: per group a quantile sketch, sums and
    counts, partitioned by the first column of `by`.

    Values of that column which are already stored are replaced, others stay: a new year is added
    by reading the rows of that year only.
    """
    scan = _first_scan(df, measure, by)
    named = scan.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(by)})
    sinks.replace_partitions(named, path, by[0])


def merged_summaries(store: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored summaries rolled up to fewer columns (none: one row), still mergeable. The rows are
    not read; the sketches are merged within each task first."""
    keys = [col(k) for k in by]
    rolled = store.groupBy(*keys).agg(
        F.kll_merge_agg_double("stat_sketch", SKETCH_SIZE).alias("stat_sketch"),
        F.sum("stat_size").alias("stat_size"),
        F.min("stat_low").alias("stat_low"),
        F.max("stat_high").alias("stat_high"),
        F.sum("stat_sum").alias("stat_sum"),
        sum_strict("stat_whole").alias("stat_whole"),
        F.sum("stat_missing").alias("stat_missing"),
    )
    return rolled


def approximate_summary(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`six_number_summary` from stored summaries alone: all but the quartiles are exact, those
    have ranks that are off by about 4e-4 of the group's rows."""
    merged = merged_summaries(store, by)
    quartiles = F.kll_sketch_get_quantile_double("stat_sketch", F.array(*[F.lit(p) for p in QUARTILES]))
    some = F.col("stat_size") > 0
    q1, median, q3 = (F.when(some, quartiles[i]) for i in range(3))
    return merged.select(
        *[col(k) for k in by],
        F.col("stat_low").alias("min"), q1.alias("q1"), median.alias("median"),
        F.try_divide("stat_sum", "stat_size").alias("mean"), q3.alias("q3"),
        F.col("stat_high").alias("max"), F.col("stat_missing").alias("missing"),
        F.col("stat_whole").alias("total"),
    )


def exact_summary(
    df: DataFrame, measure: str, store: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """`six_number_summary` of the rows behind stored summaries: the first look at the rows is the
    store's, so they are read once, to count what lies in the brackets of the quartiles."""
    if not by:
        (name,) = unused([*df.columns, *store.columns], "all")
        one = store.withColumn(name, F.lit(0))
        return exact_summary(df.withColumn(name, F.lit(0)), measure, one, [name]).drop(name)
    merged = merged_summaries(store, by)
    scan = merged.withColumnsRenamed({k: f"key_{i}" for i, k in enumerate(by)})
    return _summary(df, measure, by, staged(scan, "scan"))
