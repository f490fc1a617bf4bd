"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from levylens.sources.sinks import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b).

    Alternating stars: each node hangs its larger neighbours, then its smaller ones, on the
    smallest node next to it, until no link changes. The number of rounds grows with the logarithm
    of the number of nodes; links are combined within each task first, and each round is stored in
    the shared folder, so no node's links are gathered and lost executors repeat one round at most.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = staged(now.filter("u <> v").distinct(), "links")
    before = _fingerprint(now)
    while True:
        now = staged(_to_smaller(_to_larger(now)), "stars")
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _fingerprint(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), digest).first())


def _to_larger(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    hung = both.filter("v > u").join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _to_smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").filter("v <> m")
    hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.withColumnRenamed("m", "v")).distinct()
