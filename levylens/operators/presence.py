"""Which keys occur in which groups, as stored bitmaps.

One pass over the rows notes every key of every group as a bit; all questions about coverage are
then answered from the bitmaps, without the rows. A key has a number in a stored dictionary; a
bitmap holds the keys whose numbers fall into one bucket of 32,768, so a group has as many bitmaps
as its keys have buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from levylens.functions._column import col
from levylens.operators.joins import null_safe_join
from levylens.sources.sinks import staged


@dataclass(frozen=True)
class Presence:
    """`keys`: (key columns, number, bucket, position); `bits`: (group columns, bucket, bits, rows),
    both stored. `rows` counts the group's rows with a key of the bucket."""

    key: tuple[str, ...]
    by: tuple[str, ...]
    keys: DataFrame
    bits: DataFrame

    def key_counts(self, name: str = "n") -> DataFrame:
        """Per group the number of different keys."""
        found = self.bits.groupBy(*[col(k) for k in self.by])
        return found.agg(F.sum(F.bitmap_count("bits")).alias(name))

    def row_counts(self, name: str = "freq") -> DataFrame:
        """Per group the number of rows."""
        return self.bits.groupBy(*[col(k) for k in self.by]).agg(F.sum("rows").alias(name))

    def pairs(self) -> DataFrame:
        """Every group with every key it has: the distinct rows of both."""
        return self._decoded(self.bits)

    def in_any(self, groups: Column) -> DataFrame:
        """The keys that at least one of the picked groups has."""
        picked = self.bits.where(groups).groupBy("bucket")
        return self._decoded(picked.agg(F.bitmap_or_agg("bits").alias("bits")))

    def in_all(self, groups: Column) -> DataFrame:
        """The keys that every one of the picked groups has; none if no group is picked."""
        picked = self.bits.where(groups)
        several = picked.agg(F.count_distinct(*[F.struct(*[col(k) for k in self.by])]))
        common = picked.groupBy("bucket").agg(
            F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")
        )
        return self._decoded(common.where(F.col("n") == several.scalar()).drop("n"))

    def only_in(self, groups: Column, others: Column) -> DataFrame:
        """The keys that one of the picked groups has and none of the others."""
        here, there = (
            self.bits.where(which).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias(name))
            for which, name in ((groups, "here"), (others, "there"))
        )
        both = self.keys.join(here.join(there, "bucket", "left"), "bucket")
        absent = F.col("there").isNull() | ~_bit("there")
        return both.where(_bit("here") & absent).select(*[col(k) for k in self.key])

    def _decoded(self, bits: DataFrame) -> DataFrame:
        kept = [c for c in bits.columns if c in self.by]
        found = self.keys.join(bits, "bucket").where(_bit("bits"))
        return found.select(*[col(c) for c in [*kept, *self.key]])


def _bit(bits: str) -> Column:
    """Whether the bit of a key is set; bits are counted from the lowest of the first byte."""
    byte = F.substring(F.col(bits), (F.col("position") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.floor(value / F.pow(F.lit(2), F.col("position") % 8)) % 2 == 1


def presence(df: DataFrame, key: Sequence[str], by: Sequence[str]) -> Presence:
    """The bitmaps of the keys in each group. Runs two jobs; a missing key or group is one of them.

    Each task combines its rows' bits before they are shuffled, at most one bitmap per group and
    bucket, however often a key occurs.
    """
    own = {"number", "bucket", "position", "bits", "rows"}
    if own & {c.lower() for c in [*key, *by]}:
        raise ValueError(f"{sorted(own)} are names of the bitmaps")
    names = df.select(*[col(k) for k in key]).distinct()
    names = names.withColumn("number", F.monotonically_increasing_id() + 1)
    bucket_of = F.bitmap_bucket_number(F.col("number")).alias("bucket")
    position = F.bitmap_bit_position(F.col("number")).alias("position")
    keys = staged(names.select("*", bucket_of, position), "keys")
    numbered = null_safe_join(df.select(*[col(c) for c in dict.fromkeys([*key, *by])]), keys, key, "inner")
    bits = numbered.groupBy(*[col(k) for k in by], "bucket").agg(
        F.bitmap_construct_agg("position").alias("bits"), F.count(F.lit(1)).alias("rows")
    )
    return Presence(tuple(key), tuple(by), keys, staged(bits, "bits"))
