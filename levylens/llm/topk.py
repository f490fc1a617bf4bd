"""Exact top-k by inner product: tiled matrix products, partial selection, tree merging.

Queries and candidates are cut into tiles by a hash of their ids, each pair of a query tile and a
candidate tile is one task-sized group: one matrix product, of which every query keeps its k best.
The lists of a query are then merged in a tree, FAN lists at a time, in as many levels as there have
to be, so a task never holds more than FAN * k entries of one query. The queries are a stated set, so the work is
queries times rows by definition; rows are sent once per tile of the other side and no pair of
rows is ever a row of a table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_TILE, SHARD, FAN = 2048, 8192, 16
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) per component as array<double>; null if a component is null, NaN or
    infinite, or the vector null or empty."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    return F.when(fine & (F.size(vector) > 0), whole)


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every sum is exact, else in Python's
    integers held to the range of a long."""
    most = np.abs(queries).max() * np.abs(shard).max() * queries.shape[1]
    if most < _EXACT:
        return (queries @ shard.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m] for m in (queries, shard))
    rows = [[sum(x * y for x, y in zip(a, b, strict=True)) for b in right] for a in left]
    return np.array([[max(-_LONG, min(_LONG, x)) for x in row] for row in rows], dtype=np.int64)


def _best(k: int):
    def run(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        if not len(queries) or not len(shard):
            return empty
        shard = shard.sort_values("vec_id", kind="stable")
        ids, own = shard["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        vectors = np.stack(shard["vector"].to_list())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(own), 256):
            block = np.stack(queries["asked"].iloc[at : at + 256].to_list())
            for name, row in zip(own[at : at + 256], _products(block, vectors), strict=True):
                index = np.flatnonzero(ids != name)
                if len(index) > k:  # all that reach the k-th best score, then ties by id
                    row_i = row[index]
                    bar = np.partition(row_i, len(row_i) - k)[len(row_i) - k]
                    index = index[row_i >= bar]
                    index = index[np.lexsort((ids[index], -row[index]))[:k]]
                out.append((np.full(len(index), name), ids[index], row[index]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(empty.columns, columns, strict=True)))

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` picks, the k rows of another
    id with the highest inner product of `quantised` vectors, ties to the smaller id. Runs a job
    that counts the rows.

    Fewer than k candidates give fewer rows. Rows without id, and vectors that `quantised` makes
    null, take no part; vectors of different length are never compared. Rows that share an id are
    candidates each, repeated rows too, and as queries compete within one list. Scores beyond a long are held at its limits. Other columns of
    `vectors` are not read.
    """
    own = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        quantised(f"`{vector_col}`").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    own = own.filter("vec_id is not null and vector is not null")
    own = own.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    rows, asked = own.agg(F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, math.ceil(rows / SHARD)), max(1, math.ceil(asked / QUERY_TILE))

    def tile(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")  # spreads repeated rows

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = own.select("vec_id", "vector", "dim", tile(shards).alias("shard"))
    candidates = candidates.withColumn("block", every(blocks))
    queries = own.filter("asked").select(  # other names: both sides come from the same columns
        F.col("vec_id").alias("query_id"),
        F.col("vector").alias("asked"),
        F.col("dim").alias("query_dim"),
        tile(blocks).alias("query_block"),
        every(shards).alias("query_shard"),
    )
    pairs = queries.groupBy("query_shard", "query_block", "query_dim").cogroup(
        candidates.groupBy("shard", "block", "dim")
    )
    best = pairs.applyInPandas(_best(k), "query_id long, vec_id long, score long")
    best = best.withColumn("salt", F.monotonically_increasing_id() % 1024)  # for equal entries
    order = [F.desc("score"), F.col("vec_id")]
    lists = shards
    while True:
        lists = math.ceil(lists / FAN)
        part = F.pmod(F.xxhash64("vec_id", "salt"), F.lit(lists))
        rank = F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        if lists == 1:
            break
    return best.select("query_id", "rank", "vec_id", "score")
