"""Short test items inside long documents: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word shingles, class c holding more than
2^(c-1) and up to 2^c. For a class, a document is seen through windows of 2^(c+1) shingle places,
one every 2^c, so that every run of 2^c places lies within a window. An item and a window that
holds four fifths of it have a Jaccard similarity of 0.19 or more whatever the document's length,
and agree in one of 64 MinHash values but for one case in a million. A window that agrees with an
item makes the document a candidate; the item's shingles are then looked up in the document's
whole set, so parts found in different windows count together.

Items are held in blocks of a fixed size, each sent to all tasks; a block is one pass over the
documents, which are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from levylens.llm._words import (
    mixed, new_key, parts, shingle_sets, shingles, words as word_hashes,
)

VALUES = 64
BLOCK_SHINGLES = 1 << 18  # 2 MB of shingles in a broadcast, and 64 values of 12 bytes per item
_LOW = np.uint32(0xFFFF)
PART_BYTES = 1 << 21
_SEED = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SCALE = _SEED[:VALUES].astype(np.uint32) | np.uint32(1)
_SHIFT = _SEED[VALUES:].astype(np.uint32)


class Block:
    """Items of one broadcast: their shingles, and per size class the MinHash values to look for."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            by_class.setdefault(max(1, int(len(s) - 1).bit_length()), []).append(i)
        self.classes = []  # (c, per hash function: its values in order, whose, marks of low bits)
        for c, items in sorted(by_class.items()):
            short = [_short(sets[i]) for i in items]
            tables = []
            for scale, shift in zip(_SCALE, _SHIFT, strict=True):
                values = np.array([(x * scale + shift).min() for x in short], dtype=np.uint32)
                order = np.argsort(values, kind="stable")
                marks = np.zeros(1 << 16, dtype=bool)
                marks[values & _LOW] = True
                tables.append((values[order], np.array(items)[order], marks))
            self.classes.append((c, tables))

    def candidates(self, places: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs worth a look. The documents' shingles stand one after another,
        document d's from first[d] to first[d + 1]; a window may reach into several."""
        short, out = _short(places), set()
        for v in range(VALUES):
            least, done = short * _SCALE[v] + _SHIFT[v], 0
            for c, tables in self.classes:
                for _ in range(c - done):  # least of 2^c places each
                    odd = least[-1:] if len(least) % 2 else least[:0]
                    least = np.concatenate([np.minimum(least[:-1:2], least[1::2]), odd])
                done = c
                window = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                values, owners, marks = tables[v]
                seen = np.flatnonzero(marks[window & _LOW])
                low = np.searchsorted(values, window[seen], side="left")
                high = np.searchsorted(values, window[seen], side="right")
                for w, a, b in zip(seen.tolist(), low.tolist(), high.tolist(), strict=True):
                    if a < b:
                        from_doc = np.searchsorted(first, w << c, side="right") - 1
                        to_doc = np.searchsorted(first, (w + 2) << c, side="left")
                        docs = range(int(from_doc), min(int(to_doc), len(first) - 1))
                        out.update((d, int(i)) for d in docs for i in owners[a:b])
        return out


def _short(places: np.ndarray) -> np.ndarray:
    return (places >> np.uint64(32)).astype(np.uint32)


def _blocks(items: DataFrame, size: int, key: bytes) -> Iterator[Block]:
    """All items in blocks of at most BLOCK_SHINGLES shingles (one item at least)."""
    ids: list[int] = []
    sets: list[np.ndarray] = []
    for item_id, text in items.toLocalIterator():
        one = next(shingle_sets(pa.array([text], pa.string()), size, key))
        if not len(one):
            continue
        if ids and sum(map(len, sets)) + len(one) > BLOCK_SHINGLES:
            yield Block(ids, sets)
            ids, sets = [], []
        ids.append(item_id)
        sets.append(one)
    if ids:
        yield Block(ids, sets)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    key: bytes | None = None,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles), one row per document and item with
    100 * shared >= percent * item shingles, over the sets of distinct shingles of `words` words.

    Fewer words than `words` make one shingle of the whole sequence, which only a text of the same
    words has. Null and wordless texts are in no row, neither are rows without id; repeated rows
    are reported once each. Other columns are not read. Words are compared by 64-bit hashes under
    `key`, which is drawn anew if none is given. The items are streamed through the driver
    in blocks of BLOCK_SHINGLES; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    own = own.toDF("doc_id", "text").filter("doc_id is not null and text is not null")
    test = items.select(
        F.col(f"`{item_id_col}`").cast("long"), F.col(f"`{item_text_col}`").cast("string")
    ).toDF("item_id", "text")
    test = test.filter("item_id is not null and text is not null").distinct()
    names = ["doc_id", "item_id", "item_shingles", "shared_shingles"]
    schema = ", ".join(f"{x} long" for x in names)
    # no table of Python rows: for one, executors start a second set of Python processes
    out = spark.range(0).select(*[F.lit(None).cast("long").alias(x) for x in names])
    key = key or new_key()
    for block in _blocks(test, words, key):
        out = out.unionByName(own.mapInArrow(_search(spark, block, words, percent, key), schema))
    return out


def _search(spark, block: Block, size: int, percent: int, key: bytes):
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                rows = []
                texts = part.column(1).to_pylist()
                sequences = list(shingles(*word_hashes(texts, key), size))
                first = np.cumsum([0, *map(len, sequences)])
                if first[-1]:
                    hits: dict[int, list[int]] = {}
                    for d, i in sorted(block.candidates(np.concatenate(sequences), first)):
                        hits.setdefault(d, []).append(i)
                    ids = part.column(0)
                    for d, found in hits.items():
                        whole = np.unique(sequences[d])
                        for i in found:
                            item = block.sets[i]
                            shared = int(np.isin(item, whole, assume_unique=True).sum())
                            if 100 * shared >= percent * len(item):
                                rows.append((ids[d].as_py(), block.ids[i], len(item), shared))
                columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)]
                names = ["doc_id", "item_id", "item_shingles", "shared_shingles"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run

