"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each document is reduced to its set of distinct word shingles; equal sets form one class.
2. A class has 200 MinHash values. Classes with an equal band (5 values of 40 bands) share a
   bucket. Two sets of similarity 0.8 miss each other in all bands once in 8 million times.
3. A pair's values are compared 32 at a time. With m of n equal, the posterior of the similarity
   under a uniform prior is Beta(m + 1, n - m + 1); the pair is dropped as soon as the chance of
   reaching the threshold falls below `miss`. Pairs that survive are compared on their full sets.
4. Each bucket's members are compared with its smallest member first, and what is linked forms
   components. Only members of one bucket that are still in different components are then compared
   with each other, in tiles of bounded size: a group of copies costs a comparison per member, and
   pairs that are already connected are never looked at. No link is lost: every two classes that
   share a bucket are compared or connected.

At the end a row per document names the component: the smallest id reachable over links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from levylens.llm._graph import components
from levylens.llm._words import mixed, new_key, parts, shingle_sets
from levylens.sources.sinks import staged

BANDS, ROWS, STEP = 40, 5, 32
VALUES = BANDS * ROWS
PART_BYTES = 1 << 21
TILE = 2048  # members of a tile, and
TILE_SHINGLES = 1 << 21  # their shingles, on average
_SEED = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SCALE = (_SEED[:VALUES].astype(np.uint32) | np.uint32(1))[None, :]
_SHIFT = _SEED[VALUES:].astype(np.uint32)[None, :]


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the 200 MinHash values of a set that is not empty."""
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512] * _SCALE + _SHIFT).min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2")


def fewest_matches(similarity: float, miss: float) -> dict[int, int]:
    """For n compared values the fewest equal ones that keep P(similarity >= threshold) >= miss."""
    out = {}
    for n in [*range(STEP, VALUES, STEP), VALUES]:
        tail = 0.0  # P(Beta(m + 1, n - m + 1) >= s) = P(Binomial(n + 1, s) <= m)
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                break
        out[n] = m
    return out


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) per row; digest and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "digest", "sig"]
        for part in (p for batch in batches for p in parts(batch, 1, PART_BYTES)):
            sizes, digests, sigs = [], [], []
            for s in shingle_sets(part.column(1), words, key):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            columns = [part.column(0), pa.array(sizes, pa.int64())]
            columns += [pa.array(x, pa.binary()) for x in (digests, sigs)]
            yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return own.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _sets(docs: DataFrame, words: int, key: bytes) -> DataFrame:
    """(digest, shingles) per row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, 1, PART_BYTES)):
            sets = [s.tobytes() for s in shingle_sets(part.column(1), words, key)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            columns = [pa.array(x, pa.binary()) for x in (digests, sets)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "shingles"])

    return docs.mapInArrow(run, "digest binary, shingles binary")


def _kept_by_posterior(left: np.ndarray, right: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Indices of the rows whose pair of signatures survives all comparisons."""
    alive, equal, at = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, least in fewest.items():
        if not len(alive):
            break
        equal = equal + (left[alive, at:n] == right[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive, equal, at = alive[equal >= least], equal[equal >= least], n
    return alive


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, VALUES)


def _pruned(pairs: DataFrame, classes: DataFrame, fewest: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = _kept_by_posterior(_rows(batch.column(2)), _rows(batch.column(3)), fewest)
                yield batch.select([0, 1]).take(pa.array(alive))

    a = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(i)]
                for i in (2, 3)
            ]
            good = [_similar(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, fewest: dict[int, int], percent: int) -> DataFrame:
    """Links between members (bucket, band, tiles, node, component, sig, shingles) of different
    components, enough of them to connect all that are linked.

    A bucket is cut into tiles of bounded size and each pair of tiles is one group. A pair that also
    shares an earlier band is left to that band's bucket. Pairs that survive pruning are verified on
    their full sets at once, unless links found before have already connected them.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        band, low, high = (int(group[c].iloc[0]) for c in ("band", "low", "high"))
        sigs = np.frombuffer(b"".join(group["sig"]), dtype="<u2").reshape(-1, VALUES)
        node, root, tile = (group[c].to_numpy() for c in ("node", "component", "tile"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in sets])
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        second = np.flatnonzero(tile == high)
        links = []
        for i in np.flatnonzero(tile == low):
            other = second[root[second] != root[i]]
            if low == high:
                other = other[node[other] > node[i]]
            near = 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])
            other = other[near]
            left = np.broadcast_to(sigs[i], (len(other), VALUES))
            other = other[_kept_by_posterior(left, sigs[other], fewest)]
            same = sigs[other] == sigs[i]
            earlier = same.reshape(-1, BANDS, ROWS).all(axis=2)[:, :band].any(axis=1)
            order = np.argsort(-same.sum(axis=1), kind="stable")
            for j in other[order[~earlier[order]]]:
                a, b = top(int(root[i])), top(int(root[j]))
                if a != b and _similar(sets[i], sets[j], percent):
                    above[max(a, b)] = min(a, b)
                    links.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    own = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = own.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    return own.groupBy("bucket", "low", "high").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity_percent: int = 80,
    miss: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: bytes | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`. Runs jobs.

    Two documents are linked when 100 * shared >= similarity_percent * union on their full sets of
    distinct shingles of `words` words; fewer words make one shingle. component_id is the smallest
    id reachable over links and kept tells whether it is the row's own.

    A null or wordless text has an empty set (n_shingles 0) and is linked with nothing. A row
    without id takes no part: its component_id is null and it is kept. Where an id is repeated, each
    of its texts is linked on its own: its component is that of the row's text. Other columns of
    `docs` are not read. An empty table gives an empty result. Words are compared by 64-bit hashes
    under `key`, which is drawn anew if none is given.
    """
    fewest, key = fewest_matches(similarity_percent / 100, miss), key or new_key()
    sketch = staged(sketches(docs, words, id_col, text_col, key), "sketches")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    rep = F.min(F.struct("doc_id", "n_shingles", "sig")).alias("rep")
    nodes = known.groupBy("digest").agg(rep).select("digest", "rep.*")
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()

    keys = [
        F.struct(
            F.lit(k).alias("band"),
            F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)).alias("bucket"),
        )
        for k in range(BANDS)
    ]
    bands = nodes.select("node", "n_shingles", F.explode(F.array(*keys)).alias("key"))
    bands = bands.select("node", "n_shingles", "key.*")
    load = F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_SHINGLES)
    sizes = bands.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("node").alias("pivot"), F.ceil(load).alias("tiles")
    )
    buckets = staged(sizes.filter("size > 1"), "buckets")
    members = staged(bands.drop("n_shingles").join(buckets, "bucket"), "members")
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    shared = members.select("node").distinct().join(nodes, "node")
    shared = staged(shared.select("node", "doc_id", "digest"), "shared")
    sets = _sets(texts.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), words, key)
    if repeated:  # an id's other texts are not asked for, nor is a text twice
        sets = sets.join(shared.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    sets = staged(sets.join(shared.select("digest", "node"), "digest"), "sets")

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = staged(
        _linked(_pruned(stars.distinct(), nodes, fewest), sets, similarity_percent), "links"
    )
    roots = staged(components(links), "components")

    rooted = members.filter("size > 2").join(roots, "node", "left")
    rooted = rooted.withColumn("component", F.coalesce("component", "node"))
    several = rooted.groupBy("bucket").agg(
        F.min("component").alias("lowest"), F.max("component").alias("highest")
    )
    several = several.filter("lowest <> highest").select("bucket")
    rest = rooted.join(several, "bucket", "left_semi")
    rest = rest.join(nodes.select("node", "sig"), "node").join(sets.select("node", "shingles"), "node")
    more = staged(_tiled(rest, fewest, similarity_percent), "links")
    if not more.isEmpty():
        roots = staged(components(links.unionByName(more)), "components")

    joined = nodes.select("digest", "node", F.col("doc_id").alias("smallest"))
    joined = joined.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    names = joined.groupBy("root").agg(F.min("smallest").alias("name"))
    joined = joined.join(staged(names, "names"), "root").select("digest", "name")
    out = sketch.select("doc_id", "n_shingles", "digest").join(joined, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (component.isNull() | (component == F.col("doc_id"))).alias("kept"),
    )

