import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from levylens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, asked):
    own = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    lists = collections.defaultdict(list)
    for q, v in own:
        if asked(q):
            lists[q] += [
                (-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q and len(w) == len(v)
            ]
    return sorted((q, n + 1, i, -s) for q, found in lists.items() for n, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("shard", [topk.SHARD, 40])
def test_same_as_all_pairs(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "FAN", 3)
    monkeypatch.setattr(topk, "QUERY_TILE", 9)
    rng = random.Random(2)
    rows = [(i, [rng.randint(-3, 3) / 64 for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (None, [1.0] * 6),
             (404, [float("inf")] + [0.0] * 5), (405, [1.0, 2.0]), (420, [1.0, 2.5]), (440, [3e38] * 6),
             (441, [-3e38] * 6), (460, [0.5] * 9)]
    rows += [rows[0], rows[17], rows[17], rows[40]]  # repeated
    small = [r for r in rows if r[0] not in (440, 441)]
    for own in (small,):
        df = spark.createDataFrame([(*r, "x", "y") for r in own], SCHEMA)
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()
        assert sorted(tuple(r) for r in got) == brute(own, 7, lambda i: i % 20 == 0)


def test_huge_scores_are_held_at_the_limits(spark):
    df = spark.createDataFrame([(0, [3e38], "", ""), (1, [3e38], "", ""), (2, [-3e38], "", "")], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") == 0, k=5).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 2**63 - 1), (2, -(2**63 - 1)),
    ]


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_repeated_rows_as_in_the_sql(spark, tmp_path):
    """Query and SQL agree where rows are repeated, most of them copies of one."""
    from levylens.llm import oracle, queries
    from tests.compare import difference

    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) / 8 for _ in range(4)], 1) for i in range(60)]
    rows += [rows[0]] * 3 + [rows[20]] + [rows[7]] * 90
    folder = str(tmp_path)
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    _, problem = difference(spark, con, "op10", queries.op10_top_k, oracle.OP10, folder)
    assert problem is None, problem


def test_as_many_levels_as_needed(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 2)
    monkeypatch.setattr(topk, "FAN", 2)
    rows = [(i, [float(i % 13), 1.0]) for i in range(70)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") == 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, lambda i: i == 0)
