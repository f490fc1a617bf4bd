"""The trie of shared conversation beginnings, with totals over subtrees.

A node is a sequence of turns with which some conversation begins. It is known by a SHA-256 chain
over its turns, so equal beginnings meet without comparing texts. Totals over subtrees are rolled
up by bands of BAND depths: every node sends its numbers to the ancestors inside its band only, at
most BAND of them. The totals of the bands' roots are then completed by the same roll-up over the
tree of band roots, which is BAND times shallower, and are sent to the ancestors in the band above.
A trie of depth d thus takes about log(d) / log(BAND) levels of two rounds, and no node is sent to
more than BAND ancestors a round, however long the conversations are.

Turns are numbered, chained and banded by (conversation, place), so a conversation with a large
share of all turns is spread over tasks like any other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from levylens.sources.sinks import staged

BAND = 16
ID_BLOCK_BITS = 10  # ids are joined to text in blocks of this many bits before they are hashed
_ROOT = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _root() -> Column:
    return F.unhex(F.lit(_ROOT))


def numbered(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, place, digest, bytes): each turn's place in its conversation from 1, a digest of
    its role and text, and the UTF-8 bytes of its text. Stored. Runs jobs.

    Turns are ordered by `turn`, null first, ties by digest. A null role or text is empty. Turns
    without conversation are left out; repeated rows are turns of their own. Other columns are not
    read. The rows are range-partitioned by (conversation, turn), counted from the beginning of
    each conversation in each partition, and a conversation that began in an earlier partition goes
    on from the count there: one number per partition passes the driver.
    """
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        _sha(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).filter("conv_id is not null")
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "row"]
    own = own.withColumn("row", F.monotonically_increasing_id())  # parts even equal rows
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = staged(
        own.select("conv_id", "digest", "bytes").mapInArrow(
            _places, "conv_id long, digest binary, bytes long, part int, place long"
        ),
        "turns",
    )
    ends = runs.groupBy("part").agg(
        F.min(F.struct("conv_id", (-F.col("place")).alias("n"))).alias("first"),
        F.max(F.struct("conv_id", F.col("place").alias("n"))).alias("last"),
    )
    offsets, open_conv, reached = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row per partition
        before = reached if r["first"]["conv_id"] == open_conv else 0
        if before:
            offsets.append((r["part"], open_conv, before))
        one = r["first"]["conv_id"] == r["last"]["conv_id"]
        open_conv, reached = r["last"]["conv_id"], r["last"]["n"] + (before if one else 0)
    schema = "part int, conv_id long, before long"
    shift = F.broadcast(turns.sparkSession.createDataFrame(offsets, schema))
    place = F.col("place") + F.coalesce("before", F.lit(0))
    out = runs.join(shift, ["part", "conv_id"], "left")
    return out.select("conv_id", place.alias("place"), "digest", "bytes")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in the run of its conversation, from 1; the rows come in order."""
    part, last, reached = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        if not n:
            continue
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
        if last == conv[0]:
            place[: starts[1] if len(starts) > 1 else n] += reached
        last, reached = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int64())],
            ["conv_id", "digest", "bytes", "part", "place"],
        )


def with_shared_heads(turns: DataFrame, every: int, head: Column, longest: int) -> DataFrame:
    """Conversations rebuilt on a shared beginning: of `numbered` turns, conversation c gets the
    first `head` turns of conversation c - c % every (all if it has fewer, none if it is absent),
    then its own turns after its first `head`.

    `head` is an expression over conv_id from 0 to `longest`. Returns (conv_id, place, digest, bytes).
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "n", head.cast("long").alias("head"))
    sizes = staged(sizes.withColumn("base", F.expr(f"conv_id - conv_id % {every}")), "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(longest)).alias("in_base"))
    short = sizes.join(bases, "base", "left").filter("coalesce(in_base, 0) < head")
    short = short.select("conv_id", F.expr("head - coalesce(in_base, 0)").alias("missing"))
    own = turns.withColumn("head", head.cast("long")).filter("place > head")
    own = own.join(staged(short, "short-heads"), "conv_id", "left").select(
        "conv_id", F.expr("place - coalesce(missing, 0)").alias("place"), "digest", "bytes"
    )
    first = turns.filter(F.col("place") <= longest)
    first = first.filter(F.expr(f"conv_id % {every} = 0")).withColumnRenamed("conv_id", "base")
    heads = first.join(sizes, "base").filter("place <= head")
    return own.unionByName(heads.select("conv_id", "place", "digest", "bytes"))


def _bands(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Per level (conv_id, band, turns, keys): the turns of a conversation in bands of BAND, and the
    keys of the nodes they lead to, that of the band's root first. Level 1 has the full bands of
    level 0 as its turns, and so on, so keys[0] needs no pass along the conversation."""
    band = F.expr(f"(place - 1) div {BAND}").alias("band")
    rows = F.sort_array(F.collect_list(F.struct("place", "digest", "bytes")))  # BAND at most
    own = turns.groupBy("conv_id", band).agg(rows.alias("turns"))
    above: list[DataFrame] = []
    start, end = _root().alias("start"), F.lit(None).cast("binary").alias("end")
    if longest >= BAND:
        own = staged(own, "bands")
        whole = F.aggregate("turns", F.unhex(F.lit("")), lambda s, x: F.concat(s, x["digest"]))
        full = own.filter(F.size("turns") == BAND).select(
            "conv_id",
            (F.col("band") + 1).alias("place"),
            _sha(whole).alias("digest"),
            F.lit(0).cast("long").alias("bytes"),
        )
        above = _bands(full, longest // BAND)
        nodes = above[0].select("conv_id", "band", F.posexplode("keys").alias("at", "key"))
        nodes = nodes.filter("at > 0").select(
            "conv_id", (F.col("band") * BAND + F.col("at")).alias("to"), "key"
        )
        own = own.join(
            nodes.select("conv_id", F.col("to").alias("band"), F.col("key").alias("start")),
            ["conv_id", "band"],
            "left",
        ).join(
            nodes.select("conv_id", (F.col("to") - 1).alias("band"), F.col("key").alias("end")),
            ["conv_id", "band"],
            "left",
        )
        start = F.coalesce("start", _root()).alias("start")
        end = F.col("end")
    own = own.select("conv_id", "band", "turns", start, end)
    step = lambda keys, x: F.concat(
        keys, F.array(_sha(F.concat(F.element_at(keys, -1), x["digest"])))
    )
    keys = F.aggregate("turns", F.array("start"), step)
    kept = F.when(F.col("end").isNull(), keys).otherwise(
        F.concat(F.slice(keys, 1, BAND), F.array("end"))
    )
    return [staged(own.select("conv_id", "band", "turns", kept.alias("keys")), "keys"), *above]


def _nodes(bands: DataFrame) -> DataFrame:
    """(key, place, above, bytes, n_convs, conv_id) of the nodes but the root; `above` has the keys
    from the root of the band that the last turn lies in down to the parent."""
    at = F.col("at") + 1
    rows = bands.select("conv_id", "band", "keys", F.posexplode("turns").alias("at", "turn")).select(
        F.element_at("keys", at + 1).alias("key"),
        (F.col("band") * BAND + at).alias("place"),
        F.slice("keys", 1, at).alias("above"),
        F.col("turn.bytes").alias("bytes"),
        "conv_id",
    )
    return rows.groupBy("key").agg(
        F.first("place").alias("place"),
        F.first("above").alias("above"),
        F.first("bytes").alias("bytes"),
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    )


def _rolled_up(own: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, leaves, saved): the sums of `own` (key, place, above, leaves, saved) over each node's
    subtree. `levels` has (key, place, above) of the trees of band roots above."""
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    is_root = F.col("place") % BAND == 0
    nowhere = [F.lit(None).cast("long").alias("place"), F.lit(None).cast("array<binary>").alias("above")]
    sent = own.filter(~is_root).select(F.explode("above").alias("key"), *nowhere, "leaves", "saved")
    partial = own.unionByName(sent).groupBy("key").agg(
        F.max("place").alias("place"), F.first("above", ignorenulls=True).alias("above"), *sums
    )
    if not levels:
        return partial.select("key", "leaves", "saved")
    partial = staged(partial, "band-totals")
    roots = partial.filter(is_root)
    up = roots.select("key", "leaves", "saved").join(levels[0], "key")
    done = staged(_rolled_up(up, levels[1:]), "root-totals")
    down = done.join(roots.filter("place > 0").select("key", "above"), "key")
    down = down.select(
        F.explode(F.slice("above", 2, BAND)).alias("key"), "leaves", "saved"
    )
    rest = partial.filter(~is_root).select("key", "leaves", "saved").unionByName(down)
    return rest.groupBy("key").agg(*sums).unionByName(done.select("key", "leaves", "saved"))


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of each key's ids, ascending, comma-joined.

    The ids are joined to text by blocks of their value, then the blocks of a key are hashed one
    after another, in order, by a stream: a key with a large share of the ids is one row per block.
    """
    block = F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = ends.groupBy("key", block).agg(F.array_join(ids, ",").alias("ids"))
    blocks = blocks.repartition("key").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, out = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(f",{ids}".encode())
                    continue
                if state is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield _digest_rows(keys, out)
        if state is not None:
            yield _digest_rows([key], [state.hexdigest()])

    return blocks.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _digest_rows(keys: list[bytes], digests: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"]
    )


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations (conv_id, place, digest, bytes) with
    places from 1 without gaps; `conversations` has all ids, those without turns included.

    conv_id: the smallest conversation that begins so; depth; parent_conv_id: that of the
    beginning without the last turn (null for the root); n_convs: conversations that begin so;
    n_children; n_leaves: nodes without children in the subtree, itself included; saved_tokens: over
    the subtree, (n_convs - 1) times the bytes of the node's last text; ends_sha256: digest of the
    ids of the conversations that end here. No conversations give no rows. Runs jobs.
    """
    convs = staged(conversations.select("conv_id").filter("conv_id is not null").distinct(), "ids")
    n, smallest = convs.agg(F.count("*"), F.min("conv_id")).first()
    turns = staged(turns, "rebuilt")
    longest = turns.agg(F.max("place")).first()[0] or 0
    bands = _bands(turns, longest)
    root = turns.sparkSession.range(1 if n else 0).select(
        _root().alias("key"),
        F.lit(0).cast("long").alias("place"),
        F.array().cast("array<binary>").alias("above"),
        F.lit(0).cast("long").alias("bytes"),
        F.lit(n).cast("long").alias("n_convs"),
        F.lit(smallest).cast("long").alias("conv_id"),
    )
    nodes = staged(root.unionByName(_nodes(bands[0])), "nodes")
    places = ["key", "place", "above"]
    levels = [root.unionByName(_nodes(b)).select(*places) for b in bands[1:]]
    parent = F.when(F.col("place") > 0, F.element_at("above", -1))
    nodes_up = nodes.withColumn("parent", parent)
    children = nodes_up.filter("place > 0").groupBy(F.col("parent").alias("key"))
    children = children.agg(F.count("*").alias("n_children"))
    own = staged(nodes_up.join(children, "key", "left").fillna(0, ["n_children"]), "children")
    totals = _rolled_up(
        own.select(
            *places,
            F.expr("if(n_children = 0, 1L, 0L)").alias("leaves"),
            F.expr("(n_convs - 1) * bytes").alias("saved"),
        ),
        levels,
    )
    last = bands[0].groupBy("conv_id").agg(
        F.max(F.struct("band", F.element_at("keys", -1).alias("key")))["key"].alias("key")
    )
    ends = convs.join(last, "conv_id", "left")
    ends = ends.select(F.coalesce("key", _root()).alias("key"), "conv_id")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(totals, "key").join(_digests(ends), "key", "left").join(parents, "parent", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id",
        F.col("place").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
