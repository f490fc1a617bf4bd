import itertools
import random

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from levylens import operators as v
from levylens.functions import sum0
from levylens.operators.classes import classify, classify_by, natural_breaks, natural_breaks_by


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of the values equal, some missing."""
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{rnd.randrange(12)}"
        value = None if i % 29 == 0 else 5.0 if i % 3 == 1 else round(rnd.uniform(-10, 10), 2)
        data.append((i, group, value))
    return spark.createDataFrame(data, "id int, g string, x double").repartition(6)


def test_column_verbs(spark):
    df = spark.createDataFrame([("1", "2", "3")], "a string, b string, c string")
    assert v.col_range(df, "a", "b") == ["a", "b"]
    with pytest.raises(ValueError):
        v.col_range(df, "c", "a")
    assert v.select_positions(df, [3, 1]).columns == ["c", "a"]
    assert v.set_names(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    assert v.relocate(df, "c", before="a").columns == ["c", "a", "b"]
    assert v.relocate(df, "a", after="b").columns == ["b", "a", "c"]
    numbers = v.mutate_at(df, ["a", "b"], lambda c: F.col(c).try_cast("double"))
    assert rows(numbers) == [(1.0, 2.0, "3")]
    assert v.transmute(df, ["a"], d=F.concat("b", "c")).columns == ["a", "d"]


def test_mutate_steps_see_earlier_ones(spark):
    df = spark.createDataFrame([("a",)], "x string")
    twice = v.mutate(df, ("x", F.concat("x", F.lit("1"))), ("x", F.concat("x", F.lit("2"))))
    assert rows(twice) == [("a12",)]


def test_pivot_longer_keeps_missing_values(spark):
    df = spark.createDataFrame([("k", 1.0, None)], "k string, a double, b double")
    assert rows(v.pivot_longer(df, ["a", "b"])) == [("k", "a", 1.0), ("k", "b", None)]
    assert rows(v.pivot_longer(df, ["b"], values_to="perc")) == [("k", 1.0, "b", None)]


def test_unite(spark):
    df = spark.createDataFrame([(1, "2013", None)], "i int, y string, m int")
    out = v.unite(df, "date", ["y", "m"], sep="/")
    assert out.columns == ["i", "date"] and rows(out) == [(1, "2013/NA")]


def test_bind_rows_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, n int")
    assert rows(v.bind_rows(a, b)) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="names"):
        v.bind_rows(a, b.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="types"):
        v.bind_rows(a, b.withColumn("n", F.lit("2")))


def test_joins_match_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, l int")
    right = spark.createDataFrame([("a", 10), ("a", 11), (None, 12), ("z", 13)], "k string, r int")
    expected = [("a", 1, 10), ("a", 1, 11), ("c", 3, None), (None, 2, 12)]
    assert rows(v.left_join(left, right)) == sorted(expected, key=str)
    for bounded in (True, False):
        out = v.dimension_left_join(left, right, bounded=bounded)
        assert out.columns == ["k", "l", "r"] and rows(out) == sorted(expected, key=str)
    assert rows(v.merge_left(left, right, "k")) == sorted(expected, key=str)
    other = right.withColumnRenamed("k", "q")
    assert rows(v.merge_inner(left, other, "k", "q")) == sorted(
        [("a", 1, 10), ("a", 1, 11), (None, 2, 12)], key=str
    )
    assert rows(v.semi_join(left, right, ["k"])) == sorted([("a", 1), (None, 2)], key=str)
    assert rows(v.anti_join(left, right, ["k"])) == [("c", 3)]
    with pytest.raises(ValueError):
        v.left_join(left, other.select("q"))


def test_set_verbs(spark):
    a = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    b = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(v.intersect_keys(a, b, "k")) == sorted([("a",), (None,)], key=str)
    assert rows(v.setdiff_keys(a, b, "k")) == [("b",)]


@pytest.mark.parametrize("bounded", [True, False])
def test_ties_and_missing_values_in_top_n(spark, bounded):
    df = spark.createDataFrame([(10.0,), (9.0,), (9.0,), (8.0,)], "x double")
    assert rows(v.slice_max(df, "x", 2, bounded=bounded)) == [(10.0,), (9.0,), (9.0,)]
    assert rows(v.slice_min(df, "x", 1, bounded=bounded)) == [(8.0,)]
    few = spark.createDataFrame([(3.0,), (None,)], "x double")
    assert rows(v.slice_max(few, "x", 2, bounded=bounded)) == [(3.0,)]
    assert v.slice_head(df, 2, [F.desc("x")]).count() == 2


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("n", [1, 7, 700, 5000])
def test_both_plans_of_top_n_agree(skewed, by, n):
    for pick in (v.slice_max, v.slice_min):
        expected = rows(pick(skewed, "x", n, by=by, bounded=True))
        assert rows(pick(skewed, "x", n, by=by)) == expected


def test_slice_head_cuts_ties(skewed):
    out = v.slice_head(skewed, 3, [F.desc_nulls_last("x"), F.asc("id")], by=["g"])
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}["hot"] == 3


def test_share_and_residual_grouping(spark):
    df = spark.createDataFrame(
        [("y1", "a", 1.0), ("y1", "b", 3.0), ("y2", "a", 5.0), ("y3", "a", None), ("y3", "b", 1.0)],
        "y string, c string, x double",
    )
    for bounded in (True, False):
        out = v.share(df, {"s": "x"}, ["y"], bounded).select("y", "c", "s")
        assert rows(out) == [
            ("y1", "a", 0.25), ("y1", "b", 0.75), ("y2", "a", 1.0), ("y3", "a", None),
            ("y3", "b", None),
        ]


def test_both_plans_of_share_agree(skewed):
    known = skewed.where("x is not null")
    a = v.share(known, {"s": "x"}, ["g"], bounded=True).select("id", F.round("s", 9)).collect()
    b = v.share(known, {"s": "x"}, ["g"]).select("id", F.round("s", 9)).collect()
    assert sorted(a) == sorted(b) and len(a) == known.count()


def test_column_percent(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 20.0)], "k string, x double")
    for bounded in (True, False):
        assert rows(v.column_percent(df, bounded=bounded)) == [("a", 0.5), ("b", 0.3), ("c", 0.2)]
        top = v.slice_max(df, "x", 2, bounded=True)
        assert rows(v.column_percent(top, ["x"], bounded)) == [("a", 0.625), ("b", 0.375)]


def test_totals_row(spark):
    df = spark.createDataFrame([(2019, "Ohio", 1.0), (2019, "Iowa", 2.0)], "y int, s string, x double")
    assert rows(v.totals_row(df)) == [
        ("2019", "Iowa", 2.0), ("2019", "Ohio", 1.0), ("Total", "-", 3.0),
    ]


@pytest.mark.parametrize("bounded", [True, False])
def test_six_numbers(spark, bounded):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    out = v.six_number_summary(df, "x", bounded=bounded)
    assert out.columns == ["min", "q1", "median", "mean", "q3", "max", "missing", "total"]
    assert rows(out) == [(1.0, 1.75, 2.5, 4.0, 4.75, 10.0, 1, None)]


def test_quantiles_match_sorting(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    out = {r[0]: r[1:] for r in v.exact_quantiles(skewed, "x", probs, ["g"]).collect()}
    groups = {}
    for r in skewed.where("x is not null").collect():
        groups.setdefault(r.g, []).append(r.x)
    assert out.keys() == groups.keys() and None in groups
    for g, values in groups.items():
        assert out[g] == pytest.approx(list(np.quantile(values, probs)))


def test_quantiles_of_large_groups(spark):
    df = spark.range(400_000).selectExpr("id % 2 AS g", "double(id * 7919 % 400009) AS x")
    out = {r.g: tuple(r)[1:] for r in v.exact_quantiles(df, "x", [0.25, 0.5], ["g"]).collect()}
    for g in (0, 1):
        values = [i * 7919 % 400009 for i in range(g, 400_000, 2)]
        assert out[g] == pytest.approx(tuple(np.quantile(values, [0.25, 0.5])))


def test_a_missed_bracket_is_widened(spark):
    values = [float(x * x % 1009) for x in range(5000)]
    df = spark.createDataFrame([("a", x) for x in values], "g string, x double")
    out = v.exact_quantiles(df, "x", [0.3, 0.9], ["g"], half_width=0.0).first()
    assert tuple(out)[1:] == pytest.approx(tuple(np.quantile(values, [0.3, 0.9])))


def test_nan_is_a_missing_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1), (3.0, 2), (nan, 3), (None, 4)], "x double, _rank int")
    sums = df.agg(sum0("x").alias("s"), sum0("_rank").alias("n")).first()
    assert (sums.s, sums.n) == (4.0, 10)
    for bounded in (True, False):
        assert rows(v.slice_max(df, "x", 1, bounded=bounded)) == [(3.0, 2)]
        assert rows(v.slice_min(df, "x", 1, bounded=bounded)) == [(1.0, 1)]
    assert rows(v.slice_max(df.withColumn("g", F.lit(1)), "x", 1, by=["g"])) == [(3.0, 2, 1)]
    assert df.select(classify("x", [1.0, 3.0]).alias("c")).collect()[2].c is None


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "k"), (2.0, "k")], ["a.b", "c.d"])
    assert rows(v.slice_max(df, "a.b", 1)) == [(2.0, "k")]
    assert rows(v.slice_max(df, "a.b", 1, by=["c.d"])) == [(2.0, "k")]
    assert rows(v.slice_min(df, "a.b", 1, bounded=True)) == [(1.0, "k")]


def test_large_whole_totals(spark):
    df = spark.createDataFrame([("a", 9007199254740993), ("b", 0)], "k string, n long")
    assert v.totals_row(df).collect()[-1].n == 9007199254740993


def test_summary_verbs(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "k string, x int")
    assert [tuple(r) for r in v.frequency(df, "k").collect()] == [("a", 1), ("b", 2)]
    assert rows(v.count_rows(df, ["k"])) == sorted([("a", 1), ("b", 2), (None, 1)], key=str)
    assert rows(v.first_per_key(df, ["k"])) == sorted([("a", 2), ("b", 1), (None, 4)], key=str)
    assert [r.k for r in v.choices(df, "k").collect()] == [None, "a", "b"]
    assert v.distinct_rows(df, "k").count() == 3
    sums = v.summarise_at(df, ["k"], ["x"], F.sum, "_sum")
    assert sums.columns == ["k", "x_sum"]
    assert [r.k for r in v.reorder_by_mean(df, "k", "x").collect()] == ["a", "b", None]
    assert [r.x for r in v.arrange_desc(df, "x").collect()] == [4, 3, 2, 1]


def deviation(values):
    return sum((x - np.mean(values)) ** 2 for x in values) if len(values) else 0.0


def brute_force_breaks(values, k):
    values = sorted(values)
    distinct = sorted(set(values))
    best = min(
        itertools.combinations(distinct[:-1], min(k, len(distinct)) - 1),
        key=lambda cuts: sum(
            deviation([x for x in values if low < x <= high])
            for low, high in itertools.pairwise([-np.inf, *cuts, np.inf])
        ),
    )
    return [*best, distinct[-1]]


def test_natural_breaks_are_optimal(spark):
    rnd = random.Random(3)
    for k in (1, 2, 4, 5):
        values = [round(rnd.lognormvariate(3, 1.5), 1) for _ in range(14)] + [7.0, 7.0, 7.0]
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
        assert natural_breaks(df, "x", k) == brute_force_breaks(values, k)
    one = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert natural_breaks(one, "x", 5) == [4.0]
    assert natural_breaks(one.where("x < 0"), "x", 5) == []


def test_natural_breaks_of_many_values(spark):
    df = spark.range(12_288).selectExpr("double(id + 1e6 * (id % 3)) AS x")
    breaks = natural_breaks(df, "x", 3)
    counts = df.select(classify("x", breaks).alias("c")).groupBy("c").count().collect()
    assert sorted((r["c"], r["count"]) for r in counts) == [(1, 4096), (2, 4096), (3, 4096)]


@pytest.mark.parametrize("n", [4000, 20_000])
def test_natural_breaks_with_outliers(spark, n):
    """The classes do not depend on how many values there are."""
    outliers = [1e9, 1.0001e9, 2e9]
    df = spark.range(n).selectExpr("double(id) AS x").union(
        spark.createDataFrame([(x,) for x in outliers], "x double")
    )
    values = [*map(float, range(n)), *outliers]
    breaks = natural_breaks(df, "x", 4)
    best = min(
        (_deviation(values, [float(i), n - 1.0, 1.0001e9, 2e9]), [float(i), n - 1.0, 1.0001e9, 2e9])
        for i in range(0, n - 1)
    ) if n < 5000 else (0, [9999.0, 19999.0, 1.0001e9, 2e9])
    other = [n - 1.0, 1e9, 1.0001e9, 2e9]
    assert breaks == min(best[1], other, key=lambda b: _deviation(values, b))


def _deviation(values, breaks):
    x, total, start = np.sort(np.array(values)), 0.0, 0
    for b in breaks:
        end = np.searchsorted(x, b, side="right")
        total += float(((x[start:end] - x[start:end].mean()) ** 2).sum()) if end > start else 0.0
        start = end
    return total


def test_natural_breaks_are_the_optimum(spark):
    rng = np.random.default_rng(5)
    for k in (2, 3, 5):
        values = np.round(np.exp(rng.normal(0, 2, 60)), 3)
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        ordered = sorted(set(values.tolist()))
        cuts = combinations(ordered[:-1], k - 1) if k < 5 else []
        best = min((_deviation(values, [*c, ordered[-1]]) for c in cuts), default=None)
        got = _deviation(values, natural_breaks(df, "x", k))
        assert best is None or got == pytest.approx(best)


def test_classify(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(classify("x", [1.0, 2.0, 3.0])).collect()] == [1, 2, 3, None]
    assert df.select(classify("x", [])).first()[0] is None


def test_top_n_of_dates_and_text(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-05", 1), ("b", "2020-03-01", 1), ("c", None, 2), ("d", "2020-03-01", 2)],
        "name string, day string, g int",
    ).withColumn("day", F.to_date("day"))
    assert {r.name for r in v.slice_max(df, "day", 1).collect()} == {"b", "d"}
    assert {r.name for r in v.slice_min(df, "day", 1, by=["g"], bounded=True).collect()} == {"a", "d"}
    assert {r.name for r in v.slice_max(df, "name", 2).collect()} == {"c", "d"}


def test_joins_keep_columns_named_like_keys(spark):
    left = spark.createDataFrame([(1, "own"), (None, "none")], "k int, _key_k string")
    right = spark.createDataFrame([(1, "other"), (None, "null")], "k int, x string")
    joined = v.left_join(left, right)
    assert joined.columns == ["k", "_key_k", "x"]
    assert {tuple(r) for r in joined.collect()} == {(1, "own", "other"), (None, "none", "null")}
    assert v.semi_join(left, right, ["k"]).columns == ["k", "_key_k"]
    assert v.anti_join(left, right, ["k"]).count() == 0


def test_nan_is_arranged_last(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = [r.x for r in v.arrange_desc(df, "x").collect()]
    assert got[:2] == [3.0, 1.0]


def test_pivot_longer_refuses_names_of_columns_that_stay(spark):
    df = spark.createDataFrame([(1, 2, 3)], "variable int, a int, b int")
    with pytest.raises(ValueError):
        v.pivot_longer(df, ["a", "b"])
    assert v.pivot_longer(df, ["a", "b"], names_to="measure").count() == 2


def test_breaks_of_all_groups_at_once(spark):
    """As one group after the other, in as many jobs for twenty groups as for two."""
    rng = random.Random(11)
    rows = []
    for g in range(20):
        center = 10.0 ** rng.randint(-3, 9)
        for _ in range(rng.choice([1, 3, 6, 200])):
            rows.append((g if g else None, rng.choice([center, -center, rng.gauss(0, 1) * center, None, float("nan")])))
    rows += [(99, None), (98, 5.0), (98, 5.0)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4).cache()
    found = natural_breaks_by(df, "x", 4, ["g"])
    for g in {r[0] for r in rows}:
        one = natural_breaks(df.where(F.col("g").eqNullSafe(F.lit(g).cast("int"))), "x", 4)
        assert found.get((g,), []) == pytest.approx(one), g
    out = classify_by(df, "x", "class", found, ["g"])
    for g, x, c in out.collect():
        above = sum(x > b for b in found[g,][:-1]) if x is not None and x == x else None
        assert c == (None if above is None else above + 1)

    def jobs(groups):
        tracker, name = spark.sparkContext.statusTracker(), f"breaks-{groups}"
        spark.sparkContext.setJobGroup(name, name)
        spread = spark.range(2000).selectExpr(f"id % {groups} AS g", "double(id * 7919 % 2003) AS x")
        natural_breaks_by(spread, "x", 4, ["g"])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(20) < 2 * jobs(2)  # the rounds of the group that needs most
    df.unpersist()
