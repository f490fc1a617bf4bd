"""Words and word shingles of UTF-8 text as 64-bit hashes.

A word is a run of bytes other than blank, tab and the line separators 0x0A-0x0D; A-Z count as
a-z. Whole words are hashed, and no text is cut.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values (a null has no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text, one row at least."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _powers(n: int, base: int = _BASE, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in known or len(known[base]) < n:
        steps = np.full(max(n, 2 * PIECE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        known[base] = np.multiply.accumulate(steps)
    return known[base][:n]


def distinct_spans(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The index of one of each of the different spans, and for every span which of these it is.

    Spans, which are in order and do not overlap, are grouped by a polynomial hash; what it groups is compared byte
    by byte, so that it need not be trusted.
    """
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.add(raw, _U(1), out=total[1:], casting="unsafe")
    total[1:] *= _powers(len(raw))
    np.cumsum(total, out=total)
    keys = (total[ends] - total[starts]) * _powers(len(raw), _INVERSE)[starts]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    size, like = ends - starts, first[which]
    if (size == size[like]).all():
        del total
        before = np.cumsum(size) - size
        at = np.arange(size.sum(), dtype=np.int32)
        at += np.repeat((starts - before).astype(np.int32), size)
        own = raw[at]
        at += np.repeat((starts[like] - starts).astype(np.int32), size)
        if (raw[at] == own).all():
            return first, which
    data, known = raw.tobytes(), {}  # different spans have the same hash
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    which = np.array([known.setdefault(data[a:b], len(known)) for a, b in spans])
    return np.unique(which, return_index=True)[1], which


def new_key() -> bytes:
    """A key that nobody who writes texts knows, so that none can make two words hash alike."""
    return secrets.token_bytes(16)


def _hashed(raw: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keyed 64-bit hashes of the words of one piece, and where each starts."""
    solid = np.concatenate([[False], ~_GAP[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    low = _LOWER[raw]
    first, which = distinct_spans(low, starts, ends)
    data = low.tobytes()
    spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
    found = b"".join([blake2b(data[a:b], digest_size=8, key=key).digest() for a, b in spans])
    return np.frombuffer(found, dtype="<u8")[which], starts


def words(texts: list[str | None], key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words under `key` and, per text, where its words begin (n + 1 offsets)."""
    encoded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in encoded)])
    hashes, starts, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(raw):  # piece by piece between words, however long a word is
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw):
            gaps = np.flatnonzero(_GAP[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + PIECE_BYTES, len(raw))
        h, s = _hashed(raw[at:end], key)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0] + _U(len(parts))
    for part in parts[1:]:
        out = mixed(out * _U(_BASE) + part)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per document the shingles of `size` words in order, repeats included.

    Fewer words than `size` make one shingle of the whole sequence; no words make none.
    """
    n = len(hashes) - size + 1
    runs = _folded([hashes[i : n + i] for i in range(size)]) if n > 0 else hashes[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield runs[a : b - size + 1]
        elif b > a:
            yield _folded([hashes[i : i + 1] for i in range(a, b)])
        else:
            yield hashes[:0]


def shingle_sets(column: pa.Array, size: int, key: bytes) -> Iterator[np.ndarray]:
    """Per text its distinct shingles in ascending order."""
    for one in shingles(*words(column.to_pylist(), key), size):
        yield np.unique(one)
