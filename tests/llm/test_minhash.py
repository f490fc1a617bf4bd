import random

import pytest

from levylens.llm import minhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return minhash.near_duplicates(docs, **options).collect()


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (5, None), (6, ""), (7, " \n"), (8, "One two"), (3, "one TWO"), (9, "a b c d e f"),
        (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (11, long), (10, long + " z"),
        (12, "x" * 3_000_000),
    ]
    got = sorted(map(tuple, run(spark, rows, words=4)), key=str)
    expected = [
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 3, False), (3, 1, 3, True),
        (9, 3, 2, False), (2, 3, 2, True), (2, 3, 2, True), (None, 3, None, True),
        (11, 59_997, 10, False), (10, 59_998, 10, True), (12, 1, 12, True),
    ]
    assert got == sorted(expected, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_repeated_ids_do_not_fail(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (4, "h i j k l m n"), (5, "a b c d e f g")]
    got = run(spark, rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (4, 1), (5, 1)}


def test_texts_of_one_id_are_linked_each(spark):
    rng = random.Random(8)
    one, two = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(60)) for c in "xy")
    rows = [(1, one), (1, two), (5, one + " more"), (6, two + " more"), (6, two + " more"), (7, None)]
    got = run(spark, rows, words=4)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (6, 1, False), (7, 7, True),
    ]


def test_words_that_collide_under_polynomial_hashes(spark):
    a, b = brute.colliding_words()
    got = run(spark, [(1, a), (2, b), (3, f"{a} c d e f"), (4, f"{b} c d e f")], words=4)
    assert all(r.kept for r in got)


@pytest.fixture(scope="module")
def groups():
    """Chains and stars of near copies around the threshold, and texts that share a passage."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 25)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(20)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [minhash.TILE, 7])
def test_same_as_all_pairs(spark, groups, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", tile)
    expected = brute.near_duplicates(groups, 4)
    got = run(spark, groups, words=4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len(got) == len(groups) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pruning_keeps_what_can_reach_the_threshold():
    fewest = minhash.fewest_matches(0.8, 1e-5)
    assert list(fewest) == [32, 64, 96, 128, 160, 192, 200]
    assert all(a / n < 0.8 for n, a in fewest.items()) and fewest[200] > 120
