import hashlib
import math
import random

import numpy as np
import pytest

from levylens.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label string"
F32 = lambda x: float(np.float32(x))


def brute(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(-(2**63), min(2**63 - 1, math.floor(4096 * F32(x)))) for x in v], label))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in order if len(v) % parts == 0), None)
    if size is None:
        return [(i, None, None, label) for i, _, label in kept], None
    width = size // parts
    own = [r for r in order if len(r[1]) == size]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in own[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(cut(v, p), books[p])[1] for _, v, _ in own]
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), n in zip(own, chosen) if n == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    out = []
    for i, v, label in kept:
        if len(v) != size:
            out.append((i, None, None, label))
            continue
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in best), 2**63 - 1)
        out.append((i, "".join(f"{n:02x}" for _, n in best), error, label))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    books = vectorcodes.train(df)
    coded = vectorcodes.encoded(df, books)
    out = vectorcodes.with_label_error(coded).collect()
    return out, books.sha256()


def key(r):
    return tuple((x is None, x) for x in r)


def same(spark, rows):
    got, digest = found(spark, rows)
    want, want_digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=key) == sorted(want, key=key)
    if want_digest:
        assert digest == want_digest
    totals = {}
    for _, _, error, label in want:
        if error is not None:
            totals[label] = totals.get(label, 0) + error
    most = 2**63 - 1
    assert all(r.label_error == (min(totals[r.label], most) if r.label in totals else None) for r in got)
    return got


def made_rows(seed, n, width, spread):
    rng = random.Random(seed)
    return [
        (i, [rng.choice(range(-spread, spread + 1)) / 512 for _ in range(8 * width)], rng.choice([0, 1, 2, None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("width, spread", [(1, 3), (3, 2), (8, 900)])
@pytest.mark.parametrize("block", [vectorcodes.BLOCK, 7])
def test_same_as_the_definition(spark, width, spread, block, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    rows = made_rows(width, 150, width, spread)
    rows += [(500, None, 1), (501, [None] * 8 * width, 1), (502, [float("nan")] * 8 * width, None),
             (503, [float("inf")] + [0.0] * (8 * width - 1), 2), (504, [0.5] * 7, 1), (505, [], None),
             (506, [1.0] * 8 * (width + 1), 9), (None, rows[3][1], None), rows[0], rows[5], rows[5]]
    same(spark, rows)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 38) for _ in range(8)], i % 2) for i in range(40)]
    same(spark, rows)


def test_fewer_rows_than_entries(spark):
    got = same(spark, made_rows(9, 5, 2, 4))
    assert all(r.error == 0 for r in got)


def test_only_vectors_that_cannot_be_cut(spark):
    same(spark, [(1, [1.0, 2.0], 1), (2, None, 1)])


def test_empty_table(spark):
    assert found(spark, [])[0] == []


def test_a_walk_shares_the_open_path():
    rng = np.random.default_rng(2)
    parts = np.unique(rng.integers(-2, 3, (900, 4)), axis=0)
    entries = rng.integers(-3, 4, (6, 4))
    whole = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    walk = vectorcodes.Walk(entries)
    blocks = [walk.nearest(parts[i : i + 11]) for i in range(0, len(parts), 11)]
    assert (np.concatenate([b[0] for b in blocks]) == whole.argmin(axis=1)).all()
    assert (np.concatenate([b[1] for b in blocks]) == whole.min(axis=1)).all()
