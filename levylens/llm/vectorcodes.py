"""Product codes of integer vectors: one small codebook per part, found by rounds of assignment.

The vectors are cut into equal parts, and the distinct parts of each position are counted once,
range-partitioned and stored in lexicographic order. A round walks these ordered parts as a trie,
depth first: the vector of distances to all entries, accumulated over the first components, belongs
to a node and is shared by all parts below it, so a component is compared once per distinct prefix.
The walk advances by blocks of parts and carries the stack of the open path from one to the next.
Leaves take the nearest entry and add their components, times their count, to its sums. Only these
sums leave a task; Spark adds them up, and the driver divides parts * entries * width numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from levylens.sources.sinks import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 8192  # parts per step of the walk
_SAFE = 1 << 62  # sums below this are taken in 64 bits, larger ones in Python's integers
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """Per part position a matrix of entries * width integers."""

    entries: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1] if self.entries else 0

    def sha256(self) -> str:
        """Digest of all integers by part, entry and position within the part, comma-joined."""
        text = ",".join(str(int(x)) for book in self.entries for x in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


def floored(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, held to the range of a long; null if the vector is null or
    a component is null, NaN or infinite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x)))


def _exact(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no distance can overflow, else as Python's."""
    most = max([abs(int(x)) for m in (parts, entries) if m.size for x in (m.min(), m.max())] + [0])
    if parts.shape[1] * (2 * most) ** 2 < _SAFE:
        return parts.astype(np.int64), entries.astype(np.int64)
    return parts.astype(object), entries.astype(object)


class Walk:
    """The depth-first walk over parts in lexicographic order, block by block."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.last, self.path = entries, None, []

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (ties to the lower index) and its squared distance for each part."""
        parts, entries = _exact(parts, self.entries)
        n, width = parts.shape
        above = parts.copy()
        above[1:] = parts[:-1]
        if self.last is not None:
            above[0] = self.last
        shared = np.logical_and.accumulate((parts == above).astype(bool), axis=1)
        if self.last is None:
            shared[0] = False
        sums = np.zeros((1, len(entries)), dtype=entries.dtype)
        node, path = np.zeros(n, dtype=np.int64), []
        for d in range(width):
            opens = ~shared[:, d]
            first = np.flatnonzero(opens)
            step = parts[first, d][:, None] - entries[None, :, d]
            below = sums[node[first]] + step * step
            if opens[0]:
                node = np.cumsum(opens) - 1
            else:  # the open path of the block before
                below = np.concatenate([self.path[d][None, :], below])
                node = np.cumsum(opens)
            sums = below
            path.append(sums[node[-1]])
        if n:
            self.last, self.path = parts[-1], path
        index = np.argmin(sums, axis=1).astype(np.int64)
        return index[node], sums[np.arange(len(sums)), index][node]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(books: Codebooks):
    """Per position and entry the sum of each component and, as component -1, the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        walks: dict[int, Walk] = {}

        def add(position: int, parts: np.ndarray, count: np.ndarray) -> None:
            if position not in walks:
                walks[position] = Walk(books.entries[position])
            index, _ = walks[position].nearest(parts)
            most = max(abs(int(parts.min())), abs(int(parts.max()))) if parts.size else 0
            if int(count.sum(dtype=object)) * max(most, 1) >= _SAFE:
                parts, count = parts.astype(object), count.astype(object)
            for e in np.unique(index).tolist():
                own = index == e
                added = (count[own, None] * parts[own]).sum(axis=0).tolist()
                for d, x in enumerate([int(count[own].sum()), *added]):
                    key = (position, e, d - 1)
                    total[key] = total.get(key, 0) + int(x)

        for batch in batches:
            positions = batch.column(0).to_numpy(zero_copy_only=False)
            parts = _matrix(batch.column(1), books.width)
            counts = batch.column(2).to_numpy(zero_copy_only=False)
            for p in np.unique(positions).tolist():
                rows = np.flatnonzero(positions == p)
                for at in range(0, len(rows), BLOCK):
                    own = rows[at : at + BLOCK]
                    add(p, parts[own], counts[own])
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
            + [pa.array([str(total[k]) for k in keys], pa.string())],
            ["position", "entry", "component", "added"],
        )

    return run, "position int, entry int, component int, added string"


def train(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks:
    """The codebooks after `rounds` rounds. Runs jobs: the seeds, the distinct parts, each round.

    Vectors that `floored` makes null take no part. The seeds are the rows with the smallest ids
    (ties by vector, rows without id last); fewer rows give fewer entries, none give none. The
    first seed whose length can be cut into equal parts sets the length; vectors of another length
    are not learned from. An empty vector has empty parts. Repeated rows count as often as they
    occur. Entries that no part chose stay as they are.
    """
    own = vectors.select(
        F.col(f"`{id_col}`").alias("id"), floored(f"`{vector_col}`", scale).alias("vector")
    ).filter("vector is not null")
    order = [F.asc_nulls_last("id"), F.asc("vector")]
    first = own.filter(F.size("vector") % parts == 0).orderBy(*order).first()
    if first is None:
        return Codebooks(())
    own = own.filter(F.size("vector") == len(first["vector"]))
    width = len(first["vector"]) // parts
    seeds = [r["vector"] for r in own.orderBy(*order).limit(entries).collect()]
    cut = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]
    books = Codebooks(tuple(np.array(x, dtype=object).reshape(len(seeds), width) for x in cut))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda p: F.struct(p.alias("position"), F.slice("vector", p * width + 1, width).alias("part")),
    )
    distinct = own.select(F.explode(pieces).alias("x")).select("x.*")
    distinct = distinct.groupBy("position", "part").agg(F.count("*").alias("n"))
    distinct = distinct.repartitionByRange("position", "part")
    distinct = staged(distinct.sortWithinPartitions("position", "part"), "parts")
    for _ in range(rounds):
        books = _next(distinct, books)
    return books


def _next(distinct: DataFrame, books: Codebooks) -> Codebooks:
    run, schema = _sums(books)
    found = distinct.select("position", "part", "n").mapInArrow(run, schema)
    found = found.groupBy("position", "entry", "component").agg(
        F.sum(F.col("added").cast("decimal(38,0)")).alias("added")
    )
    total = {(r.position, r.entry, r.component): int(r.added) for r in found.collect()}
    entries = [book.copy() for book in books.entries]
    for (p, e, component), added in total.items():
        if component >= 0:
            entries[p][e, component] = added // total[p, e, -1]
    return Codebooks(tuple(entries))


def encoded(
    vectors: DataFrame,
    books: Codebooks,
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """The rows whose vector `floored` does not make null, with `code` (the 0-based index of the
    nearest entry of each part, two hex digits each) and `error` (the squared distances summed over
    the parts, held to a long) in place of any columns of these names, without the vector.

    Vectors of another length than the codebooks have a null code and error. Repeated rows stay.
    The distinct parts of each batch are walked as a trie like in `train`; no row is moved.
    """
    rest = [c for c in vectors.columns if c.lower() not in (vector_col.lower(), "code", "error")]
    kept = vectors.select(
        *[F.col(f"`{c}`") for c in rest], floored(f"`{vector_col}`", scale).alias(vector_col)
    ).filter(F.col(f"`{vector_col}`").isNotNull())
    fits = F.size(F.col(f"`{vector_col}`")) == len(books.entries) * books.width
    schema = kept.select(*[F.col(f"`{c}`") for c in rest]).schema
    schema = schema.add("code", "string").add("error", "long")
    if not books.entries:
        return kept.select(
            *[F.col(f"`{c}`") for c in rest],
            F.lit(None).cast("string").alias("code"),
            F.lit(None).cast("long").alias("error"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            whole = _matrix(batch.column(len(rest)), books.width * len(books.entries))
            code = np.zeros((n, len(books.entries)), dtype=np.uint8)
            error = np.zeros(n, dtype=object)
            for p, entries in enumerate(books.entries):
                own = whole[:, p * books.width : (p + 1) * books.width]
                distinct, back = own, np.arange(n)
                if books.width:
                    distinct, back = np.unique(own, axis=0, return_inverse=True)
                index, distance = Walk(entries).nearest(distinct)
                code[:, p] = index[back.ravel()]
                error += distance[back.ravel()].astype(object)
            text, size = code.tobytes().hex(), 2 * len(books.entries)
            codes = [text[i * size : (i + 1) * size] for i in range(n)]
            errors = [min(int(x), _LONG) for x in error]
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=schema.names,
            )

    coded = kept.filter(fits).mapInArrow(run, schema)
    other = kept.filter(~fits).select(
        *[F.col(f"`{c}`") for c in rest],
        F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("long").alias("error"),
    )
    return coded.unionByName(other)


def with_label_error(
    coded: DataFrame, label_col: str = "label", error_col: str = "error"
) -> DataFrame:
    """`coded` with `label_error`, the error summed over the rows of equal label (null is a label of
    its own; null errors count nothing, and labels that have no other get a null), held to a long.

    The errors are summed per label within each task first; the stored totals are joined back.
    """
    own = coded.drop(*[c for c in coded.columns if c.lower() == "label_error"])
    label = F.col(f"`{label_col}`")
    total = F.sum(F.col(f"`{error_col}`").cast("decimal(38,0)"))
    held = F.when(total.isNotNull(), F.least(total, F.lit(_LONG).cast("decimal(38,0)")))
    totals = own.groupBy(label.alias("_label")).agg(held.cast("long").alias("label_error"))
    totals = staged(totals, "label-errors")
    joined = own.join(totals, label.eqNullSafe(totals["_label"]), "left")
    return joined.drop(totals["_label"])

