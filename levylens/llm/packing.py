"""Cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs a * n + b * n^2: the layers' linear work and attention within the piece.
The sequences of a group are opened with exactly as much capacity as the group has tokens: full
ones, and at the end of a partition the powers of two that the rest consists of, which need no
padding either. Pieces are taken in descending order of length, and each goes to the sequence with
the lowest cost that still has room for it. Where none has room for the whole piece, it is cut: a
part fills the sequence with the most room, and the rest waits for its turn by length.

Each task packs its own documents in groups of bounded size, so nothing is shuffled and no table
is gathered. A sequence's number is made of the partition's and a count.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from levylens.llm._words import buffers, distinct_spans, parts

LENGTH = 1024
GROUP_TOKENS = 1 << 19
PART_BYTES = 1 << 19  # of text encoded together, which takes some twenty times as much
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
CACHED_PARTS, CACHED_BYTES = 500_000, 1 << 25
TOGETHER = 400  # new words that are encoded as one text
SIGNS = b".,;:!?"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, sequence_length long, cost double"
)


class Encoder:
    """Token ids of texts by a tokenizer file, with the ids of words remembered.

    No token reaches across a blank or a line feed that stands alone between two other characters,
    but for the one that begins with the blank; nor from an ASCII letter or digit to a sign of SIGNS
    after it. Texts are cut there. Equal words of a slice are found by a hash and told from others by
    their bytes; the different ones are looked up by their bytes, and those that were not met yet
    are encoded together and told apart by the bytes of their tokens. Texts with other white space
    next to a blank or line feed are encoded as they are. Strings of special tokens in a text are
    ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.width = np.array([len(x) for x in names])  # one character stands for one byte
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}  # of words in the lists below
        self.at, self.n, self.pool = (Growing() for _ in range(3))  # ids of word i: pool[at : at + n]
        self.held = 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.int64) for x in found]

    def _learn(self, words: list[bytes]) -> None:
        """Remember words; those next to white space with -1 ids."""
        head = np.fromiter((w[0] for w in words), np.uint8, len(words))
        spaced = head == 0x20
        begin = np.fromiter((w[1] if len(w) > 1 else 0x20 for w in words), np.uint8, len(words))
        begin[~spaced] = head[~spaced]
        end = np.fromiter((w[-1] for w in words), np.uint8, len(words))
        even = ~(_SPACE[begin] | _SPACE[end])
        for i in np.flatnonzero(even & ((begin > 127) | (end > 127))).tolist():
            bare = words[i].decode().removeprefix(" ")
            even[i] = not (bare[0].isspace() or bare[-1].isspace())
        even |= np.fromiter((w == b"\n" for w in words), bool, len(words))
        spaced &= even
        at, n = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
        new, used = [], len(self.pool)
        if spaced.any():
            inside = np.flatnonzero(spaced)
            own = [words[i] for i in inside.tolist()]
            texts = [b"".join(own[i : i + TOGETHER]).decode() for i in range(0, len(own), TOGETHER)]
            ids = np.concatenate(self.plain(texts))
            ends = np.cumsum([len(words[i]) for i in inside.tolist()])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            at[inside] = used + np.concatenate([[0], cuts[:-1]])
            n[inside] = np.diff(cuts, prepend=0)
            new.append(ids)
            used += len(ids)
        others = np.flatnonzero(even & ~spaced)
        found = self.plain([words[i].decode() for i in others.tolist()])
        n[others] = sizes = np.array([len(x) for x in found], dtype=np.int64)
        at[others] = used + np.cumsum(sizes) - sizes
        self.places.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.at.extend(at)
        self.n.extend(n)
        self.pool.extend(np.concatenate([*new, *found, np.zeros(0, dtype=np.int64)]))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; text i has the bytes raw[offsets[i] : offsets[i + 1]]."""
        out = [np.zeros(0, dtype=np.int64)] * (len(offsets) - 1)
        if not len(raw):
            return out
        if len(self.places) > CACHED_PARTS or self.held > CACHED_BYTES:
            self.forget()
        starts = _cuts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        first, word = distinct_spans(raw, starts, ends)
        data = raw.tobytes()
        words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        place = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self.at), len(self.at) + len(new))
        if len(new):
            self._learn([words[i] for i in new.tolist()])
        at, n = (x.values[place].astype(np.int64)[word] for x in (self.at, self.n))
        length = np.maximum(n, 0)
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool.values[np.repeat(at - total[:-1], length) + np.arange(total[-1])]
        doc = np.searchsorted(starts, offsets)
        uneven = np.unique(np.searchsorted(doc, np.flatnonzero(n < 0), side="right") - 1).tolist()
        bounds = total[doc].tolist()
        for i in range(len(out)):
            out[i] = ids[bounds[i] : bounds[i + 1]]
        texts = [data[offsets[i] : offsets[i + 1]].decode() for i in uneven]
        for i, whole in zip(uneven, self.plain(texts), strict=True):
            out[i] = whole
        return out


class Growing:
    """A list of numbers that is extended by arrays."""

    def __init__(self) -> None:
        self.space, self.size = np.zeros(1 << 12, dtype=np.int32), 0

    def __len__(self) -> int:
        return self.size

    @property
    def values(self) -> np.ndarray:
        return self.space[: self.size]

    def extend(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.space):
            space = np.zeros((self.size + len(more)) * 3 // 2, dtype=np.int32)
            space[: self.size] = self.values
            self.space = space
        self.space[self.size : self.size + len(more)] = more
        self.size += len(more)


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at texts, blanks, line feeds, what follows these, and signs."""
    cut = (raw == 0x20) | (raw == 0x0A)
    cut[1:] |= raw[:-1] == 0x0A
    cut[1:] |= _SIGN[raw[1:]] & _ALNUM[raw[:-1]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_SIGN, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGN[list(SIGNS)] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def capacities(tokens: int, last: bool) -> list[int]:
    """Full sequences, and if no more tokens follow the powers of two that make up the rest."""
    out = [LENGTH] * (tokens // LENGTH)
    rest = tokens % LENGTH if last else 0
    return out + [1 << k for k in reversed(range(LENGTH.bit_length())) if rest >> k & 1]


def packed(pieces: list[Piece], room: list[int]) -> Iterator[tuple[int, Piece]]:
    """(sequence, part) for all pieces; `room` has the tokens of the pieces in all.

    The sequences with room for the piece in hand are a heap by cost, the others are kept by the
    room they have; pieces come in descending order, so a sequence enters the heap at the length it
    has room for. What is left of a cut piece is placed in its turn.
    """
    left, cost = list(room), [0.0] * len(room)
    turns = [(-len(p.ids), i, p) for i, p in enumerate(pieces) if len(p.ids)]
    heapq.heapify(turns)
    fits: list[tuple[float, int]] = []
    others: list[list[int]] = [[] for _ in range(LENGTH + 1)]
    for i, n in enumerate(left):
        others[n].append(i)
    least = LENGTH + 1  # all sequences with so much room are in the heap
    order = len(pieces)
    while turns:
        _, _, piece = heapq.heappop(turns)
        n = len(piece.ids)
        while least > n:
            least -= 1
            for i in others[least]:
                heapq.heappush(fits, (cost[i], i))
            others[least] = []
        if fits:
            _, i = heapq.heappop(fits)
        else:
            most = next(m for m in range(least - 1, 0, -1) if others[m])
            i = min(others[most], key=lambda j: (cost[j], j))
            others[most].remove(i)
            rest = Piece(piece.doc, piece.start + most, piece.ids[most:], piece.doc_tokens)
            heapq.heappush(turns, (-len(rest.ids), order, rest))
            order += 1
            piece = Piece(piece.doc, piece.start, piece.ids[:most], piece.doc_tokens)
            n = most
        yield i, piece
        left[i] -= n
        cost[i] += LINEAR * n + QUADRATIC * n * n
        if left[i] >= least:
            heapq.heappush(fits, (cost[i], i))
        else:
            others[left[i]].append(i)


def _split(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first `tokens` tokens of the pieces, and the rest."""
    total = 0
    for i, p in enumerate(pieces):
        if total + len(p.ids) > tokens:
            cut = tokens - total
            first = [Piece(p.doc, p.start, p.ids[:cut], p.doc_tokens)] if cut else []
            rest = Piece(p.doc, p.start + cut, p.ids[cut:], p.doc_tokens)
            return [*pieces[:i], *first], [rest, *pieces[i + 1 :]]
        total += len(p.ids)
    return pieces, []


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of its
    ids as little-endian 32-bit numbers), doc_tokens, sequence_id, offset (its place in the
    sequence), sequence_length and cost (of the piece).

    A document is its text's ids without special tokens, and the id 0 at the end; a null text is
    empty, so every row has a token at least. Every id lies in one piece. A sequence has up to 1024
    tokens; those that have fewer have a power of two. Repeated rows and rows without id are packed
    like others. Other columns are not read. `tokenizer_path` has to be readable on all executors.
    """
    own = docs.select(
        F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[Piece] = []
        tokens = 0

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tokens, sequence
            room = capacities(tokens, last)
            now, waiting = _split(waiting, sum(room))
            tokens -= sum(room)
            yield _rows(packed(now, room), room, sequence)
            sequence += len(room)

        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                found = encoder.encode(*buffers(part.column(1)))
                for doc, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    whole = np.append(ids, 0).astype("<u4")
                    tokens += len(whole)
                    waiting += [
                        Piece(doc, s, whole[s : s + LENGTH], len(whole))
                        for s in range(0, len(whole), LENGTH)
                    ]
                if tokens >= GROUP_TOKENS:
                    yield from flushed(False)
        if waiting:
            yield from flushed(True)

    return own.mapInArrow(run, SCHEMA)


def _rows(placed: Iterator[tuple[int, Piece]], room: list[int], first: int) -> pa.RecordBatch:
    filled = [0] * len(room)
    rows = []
    for i, p in placed:
        n = len(p.ids)
        crc = zlib.crc32(p.ids)
        cost = LINEAR * n + QUADRATIC * n * n
        rows.append((p.doc, p.start, n, crc, p.doc_tokens, first + i, filled[i], room[i], cost))
        filled[i] += n
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    types = [pa.int64()] * 8 + [pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
