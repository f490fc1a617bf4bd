"""Natural-break classes of a measure, as used to shade a map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from levylens.functions._column import ColumnLike, col, unused
from levylens.functions.aggregates import known
from levylens.operators.joins import null_safe_join
from levylens.sources.sinks import staged

FIRST_BINS, SPLIT = 512, 16
OPEN_SHARE = 1 / 64


def natural_breaks(df: DataFrame, measure: ColumnLike, k: int) -> list[float]:
    """Upper bounds of the k classes with the least squared deviation from their class means.

    Runs Spark jobs; NULL and NaN are left out. Values are counted in bins, FIRST_BINS of equal
    width at first, and the best classes made of whole bins are found from the bins' counts and
    sums. Then every bin next to a break, and every bin whose own squared deviation is more than
    OPEN_SHARE of all classes', is cut into SPLIT parts and the values are counted again, until a
    bin next to a break holds one value and no other bin is worth cutting. Any input takes these
    steps. The driver receives the bins only: the open ones number 2k + 1 / OPEN_SHARE at most.
    """
    value = known(measure).cast("double").alias("v")
    values = df.select(value).where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    low, high, mean = values.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    if low is None:
        return []
    edges = np.unique(np.linspace(low, high, FIRST_BINS + 1)[1:-1])
    while True:
        bins = _counted(values, edges, mean)
        own = bins["spread"]
        single = bins["low"] == bins["high"]
        ends = _optimal_cuts(bins["mean"], bins["n"], min(k, len(own)))
        near = np.zeros(len(own), dtype=bool)
        near[ends[:-1]] = True
        near[[e + 1 for e in ends[:-1]]] = True
        if len(own) < k:
            near[:] = True
        total = _deviation_of(bins, ends) + own.sum()
        cut = ~single & (near | (own > OPEN_SHARE * total))
        inner = [
            np.linspace(a, b, SPLIT + 1)[:-1]
            for a, b in zip(bins["low"][cut], bins["high"][cut], strict=True)
        ]
        more = np.unique(np.concatenate([edges, *inner, bins["low"][cut]]))
        if len(more) == len(edges):
            return [float(bins["high"][e]) for e in ends]
        edges = more


def _counted(values: DataFrame, edges: np.ndarray, center: float) -> dict[str, np.ndarray]:
    """Per bin that has values: count, lowest, highest, mean and sum of squared deviations. An
    edge belongs to the bin on its left."""
    splits = [-float("inf"), *np.nextafter(edges, np.inf).tolist(), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="v", outputCol="bin").transform(values)
    off = F.col("v") - center
    rows = (
        binned.groupBy("bin")
        .agg(F.count("*"), F.min("v"), F.max("v"), F.avg(off), F.var_pop("v") * F.count("*"))
        .collect()
    )
    table = np.array(sorted(tuple(r)[1:] for r in rows), dtype=float)
    table = table[np.argsort(table[:, 1])]
    names = ("n", "low", "high", "mean", "spread")
    return {name: table[:, i] for i, name in enumerate(names)}


def _deviation_of(bins: dict[str, np.ndarray], ends: list[int]) -> float:
    total, start = 0.0, 0
    for end in ends:
        x, w = bins["mean"][start : end + 1], bins["n"][start : end + 1]
        total += float((w * (x - np.average(x, weights=w)) ** 2).sum())
        start = end + 1
    return total


def _optimal_cuts(x: np.ndarray, w: np.ndarray, k: int) -> list[int]:
    """Last index of each of k consecutive classes that minimise squared deviation. What the
    members of one index deviate from their own mean is the same for all classes."""
    x = x - np.average(x, weights=w)
    zero = np.zeros(1)
    cw, cx, cxx = (np.concatenate([zero, np.cumsum(v)]) for v in (w, w * x, w * x * x))
    n = len(x)

    def deviation(starts: np.ndarray, end: int) -> np.ndarray:
        weight, total = cw[end] - cw[starts], cx[end] - cx[starts]
        return cxx[end] - cxx[starts] - total * total / weight

    best = np.concatenate([[np.inf], cxx[1:] - cx[1:] * cx[1:] / cw[1:]])
    back = []
    for classes in range(2, k + 1):
        previous, best = best, np.full(n + 1, np.inf)
        start_of = np.zeros(n + 1, dtype=int)
        # The best start does not move back as the end moves on: divide and conquer.
        spans = [(classes, n, classes - 1, n - 1)]
        while spans:
            first, last, lowest, highest = spans.pop()
            if first > last:
                continue
            end = (first + last) // 2
            starts = np.arange(lowest, min(end - 1, highest) + 1)
            cost = previous[starts] + deviation(starts, end)
            start_of[end] = start = int(starts[cost.argmin()])
            best[end] = cost.min()
            spans += [(first, end - 1, lowest, start), (end + 1, last, start, highest)]
        back.append(start_of)

    ends = [n]
    for start_of in reversed(back):
        ends.append(int(start_of[ends[-1]]))
    return [e - 1 for e in reversed(ends)]


def natural_breaks_by(
    df: DataFrame, measure: ColumnLike, k: int, by: Sequence[str]
) -> dict[tuple, list[float]]:
    """`natural_breaks` of every group at once, by group. Runs jobs, as many for many groups as for
    one.

    All groups go through the same rounds. A value is first counted in one of FIRST_BINS equal
    parts of its group's range; each round the bins worth cutting of all groups are cut into SPLIT
    parts, and only their values are read again, each moved on from its bin to a part of it. Values
    are combined within each task by group and bin. The driver receives a group's bins, of which
    2k + 1 / OPEN_SHARE at most are open, and finds its best classes by divide and conquer. The
    groups should be few, like the years of a series.
    """
    keys = [f"key_{i}" for i in range(len(by))]
    value = F.col("v")
    rows = df.select(
        *[col(c).alias(key) for c, key in zip(by, keys, strict=True)],
        known(measure).cast("double").alias("v"),
    ).where(value.isNotNull() & (F.abs("v") < float("inf")))
    ranges = rows.groupBy(*keys).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("center")
    )
    ranges = staged(ranges, "ranges")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    schema = ", ".join([*kinds, "low double", "high double", "bin long", "number long"])
    first = ranges.select(*keys, "low", "high", F.lit(0).alias("bin"), F.lit(0).alias("number"))
    now = _moved(rows.withColumn("bin", F.lit(0)), first, keys, FIRST_BINS)
    bins: dict[tuple, list[tuple]] = {}  # (count, low, high, mean, deviation, number or None)
    while True:
        now = staged(now, "values")
        for group, fresh in _bins(now, ranges, keys).items():
            bins.setdefault(group, []).extend(fresh)
        again, gone, breaks = [], [], {}
        for group, own in bins.items():
            own.sort(key=lambda b: b[1])
            cut, breaks[group] = _to_cut(own, k)
            for b, wanted in zip(own, cut, strict=True):
                if wanted:  # a bin that was left alone in an earlier round has no number any more
                    (again if b[5] is not None else gone).append((*group, b[1], b[2], b[5]))
            bins[group] = [(*b[:5], None) for b, wanted in zip(own, cut, strict=True) if not wanted]
        if not again and not gone:
            return breaks
        again = [(*part, i) for i, part in enumerate(again)]
        gone = [(*part, len(again) + i) for i, part in enumerate(gone)]
        parts, lost = (df.sparkSession.createDataFrame(x, schema) for x in (again, gone))
        now = _moved(now, parts, keys, SPLIT)
        if gone:
            named = lost.withColumn("bin", F.col("number"))
            found = null_safe_join(rows, named.select(*keys, "low", "high", "bin"), keys, "inner")
            found = found.where(value.between(F.col("low"), F.col("high"))).select(*keys, "v", "bin")
            now = now.unionByName(_moved(found, named, keys, SPLIT))


def _moved(rows: DataFrame, parts: DataFrame, keys: Sequence[str], splits: int) -> DataFrame:
    """The rows of the bins `parts` (keys, low, high, bin, number), moved on to one of `splits` equal
    parts of their bin's range, numbered from number * splits."""
    both = null_safe_join(rows, parts, [*keys, "bin"], "inner")
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * splits), F.lit(splits - 1))
    return both.select(*keys, "v", (F.col("number") * splits + part).alias("bin"))


def _bins(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> dict[tuple, list[tuple]]:
    """Per group its bins: count, lowest, highest, mean and squared deviation (both from the
    group's mean), number."""
    both = null_safe_join(rows, ranges.select(*keys, "center"), keys, "inner")
    off = F.col("v") - F.col("center")
    found = both.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.avg(off).alias("mean"), (F.var_pop("v") * F.count(F.lit(1))).alias("spread"),
    )
    out: dict[tuple, list[tuple]] = {}
    for r in found.collect():
        group = tuple(r[key] for key in keys)
        out.setdefault(group, []).append((r["n"], r["low"], r["high"], r["mean"], r["spread"], r["bin"]))
    return out


def _to_cut(own: list[tuple], k: int) -> tuple[np.ndarray, list[float]]:
    """Which of a group's bins in order have to be cut, and the upper bounds of its classes."""
    n, low, high, mean, spread = (np.array([b[i] for b in own], dtype=float) for i in range(5))
    ends = _optimal_cuts(mean, n, min(k, len(own)))
    near = np.zeros(len(own), dtype=bool)
    near[ends[:-1]] = True
    near[[e + 1 for e in ends[:-1]]] = True
    if len(own) < k:
        near[:] = True
    bins = {"n": n, "low": low, "high": high, "mean": mean, "spread": spread}
    total = _deviation_of(bins, ends) + spread.sum()
    return (low < high) & (near | (spread > OPEN_SHARE * total)), [float(high[e]) for e in ends]


def classify_by(df: DataFrame, measure: str, name: str, breaks: dict[tuple, list[float]], by: Sequence[str]) -> DataFrame:
    """`df` with the class of each row under its group's breaks; NULL for a missing value, and in a
    group without breaks."""
    keys = df.select(*[col(c) for c in by]).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys]
    (bounds,) = unused(df.columns, "bounds")
    schema = ", ".join([*kinds, f"`{bounds}` array<double>"])
    table = df.sparkSession.createDataFrame([(*g, b[:-1]) for g, b in breaks.items()], schema)
    joined = null_safe_join(df, table, by, "left")
    value = known(measure)
    above = F.size(F.filter(bounds, lambda b: value > b)) + 1
    known_class = F.when(value.isNotNull() & F.col(bounds).isNotNull(), above)
    return joined.withColumn(name, known_class).drop(bounds)


def classify(measure: ColumnLike, breaks: list[float]) -> Column:
    """Class number 1..k by upper bounds; NULL for a missing value and for NaN."""
    value = known(measure)
    if not breaks:
        return F.lit(None).cast("int")
    above = [F.when(value > b, 1).otherwise(0) for b in breaks[:-1]]
    return F.when(value.isNotNull(), sum(above, F.lit(1)))
