"""Placement of records on shards by a permutation-filled lookup table of prime size.

Every shard has its own order of preference over the slots, (offset + j * skip) mod size. The
shards take turns; at its turn a shard claims the first free slot of its order. The table has a
fixed size, so it is broadcast whatever the data, and a record finds its shard with one hash and
one look-up. Slots differ by at most one per shard, and a shard that joins or leaves moves few
other records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 8191  # a prime, 128 times the number of shards below
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The index of the shard that holds each slot. `slots` must be a prime."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the table size {slots} is not a prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be different names, one at least, no more than slots")
    at = [_number(f"offset:{name}") % slots for name in shards]
    skip = [_number(f"skip:{name}") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        table[at[i]] = i
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """(slot, shard): as many rows as `slots`."""
    names = ",".join(str(i) for i in fill(shards, slots))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("slot", "i"))
    shard = F.element_at(F.array(*[F.lit(name) for name in shards]), F.col("i").cast("int") + 1)
    return rows.select("slot", shard.alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key, from the first 60 bits of its text's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), slots)


def placed(
    rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """`rows` with the columns slot and shard (replacing any of these names).

    The rows are not moved: the table is joined by broadcast, its size is the parameter `slots`.
    Equal keys share a shard; a null key is placed like an empty text. Repeated rows stay.
    """
    slot = slot_of(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), slots).cast("int")
    table = lookup_table(rows.sparkSession, shards, slots)
    kept = rows.drop(*[c for c in rows.columns if c.lower() in ("slot", "shard") and c != key])
    if key.lower() in ("slot", "shard"):
        raise ValueError("the key column must not be called slot or shard")
    return kept.withColumn("slot", slot).join(F.broadcast(table), "slot")
