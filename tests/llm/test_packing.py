import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from levylens.llm import packing
from levylens.llm._words import buffers, parts
from levylens.llm.queries import op2_packing, tokenizer_path
from tests.llm.brute import colliding_words

ODD = ["", "  a b", " a", "a ", "a  b", "x  y", "<|endoftext|> hi <|endoftext|>", "ab\n c", "é à ü 日本 語",
       "a\tb c", "can't  don't we've", " ", "\n", "x 　y z", "\x1c a", "a\r\n b", "one two three", "a\n\nb", "\na", "a\n", "a\nb\nc, d.\nE", " a\nb", "a \nb", "a\n b",
       "x, y. z! w? 'tis it's, 1,000. 3.14 a.b.c... ok... \"q\", é, ü. ²: Ⅷ; 日本, _,.", "it's. they've! 's, '", "a,\nb"]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def checked(rows, expected):
    """Every id in one piece, sequences without gaps, no padding but at a power of two."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == expected.keys()
    for doc, pieces in by_doc.items():
        ids, at = np.array(expected[doc], dtype="<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0 and {p.sequence_length for p in pieces} == {at}
    return by_sequence


def test_round_trip(spark, reference):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sequences = checked(op2_packing(spark, folder).collect(), {r.doc_id: reference(r.text) for r in docs})
    assert sum(len(s) > 0 and s[0].sequence_length == 1024 for s in sequences.values()) > 0.9 * len(sequences)


def test_edges(spark, reference):
    texts = [*ODD, None, "long " * 30_000, "x" * 50_000]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, start int, cost string")
    rows = packing.pack(df, tokenizer_path()).collect()
    checked(rows, {i: reference(t) for i, t in enumerate(texts)})
    assert packing.pack(df.limit(0), tokenizer_path()).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), tokenizer_path())
    assert [r.doc_id for r in twice.collect()] == [None, None]


def test_remembered_parts_give_the_same_ids(monkeypatch):
    encoder = packing.Encoder(tokenizer_path())
    for limit in (packing.CACHED_PARTS, 5):
        monkeypatch.setattr(packing, "CACHED_PARTS", limit)
        for _ in range(3):
            found = encoder.encode(*buffers(pa.array(ODD)))
            assert [x.tolist() for x in found] == [x.tolist() for x in encoder.plain(ODD)]


def test_words_that_collide_under_polynomial_hashes(reference):
    a, b = colliding_words()
    encoder = packing.Encoder(tokenizer_path())
    for _ in range(2):
        texts = [f"x {a} {b}", f"x {b} {a}", a, b, f"{b}\n{a}"]
        found = encoder.encode(*buffers(pa.array(texts)))
        assert [x.tolist() for x in found] == [reference(t)[:-1] for t in texts]


def test_lowest_cost_with_room():
    pieces = [packing.Piece(i, 0, np.zeros(n, dtype="<u4"), n) for i, n in enumerate([500, 900, 124, 524])]
    placed = list(packing.packed(pieces, [1024, 1024]))
    assert [(s, p.doc, len(p.ids)) for s, p in placed] == [(0, 1, 900), (1, 3, 524), (1, 0, 500), (0, 2, 124)]
    # a piece that fits nowhere is cut, the roomiest sequence first
    pieces = [packing.Piece(i, 0, np.zeros(n, dtype="<u4"), n) for i, n in enumerate([700, 700, 648])]
    cut = [(s, p.doc, p.start, len(p.ids)) for s, p in packing.packed(pieces, [1024, 1024])]
    assert cut == [(0, 0, 0, 700), (1, 1, 0, 700), (0, 2, 0, 324), (1, 2, 324, 324)]


def test_capacities():
    assert packing.capacities(2 * 1024 + 700, False) == [1024, 1024]
    assert packing.capacities(1024 + 700, True) == [1024, 512, 128, 32, 16, 8, 4]


def test_memory_of_a_batch():
    """3.8 MB of text are encoded in slices that take 16 MB at most, beside the words remembered."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=16_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    encoder = packing.Encoder(tokenizer_path())
    encoder.encode(*buffers(batch.column(1)))  # the words and what is kept by the process
    tracemalloc.start()
    try:
        for part in parts(batch, 1, packing.PART_BYTES):
            encoder.encode(*buffers(part.column(1)))
        assert tracemalloc.get_traced_memory()[1] < 16_000_000
    finally:
        tracemalloc.stop()
