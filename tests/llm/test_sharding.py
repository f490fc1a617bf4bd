import collections

import pytest

from levylens.llm import sharding


def test_turns_and_balance():
    names = ["a", "b", "c"]
    table = sharding.fill(names, 101)
    assert sorted(collections.Counter(table).values()) == [33, 34, 34]
    # by definition: in turns, each the first free slot of its own order
    offset = [sharding._number(f"offset:{n}") % 101 for n in names]
    skip = [sharding._number(f"skip:{n}") % 100 + 1 for n in names]
    free, expected = set(range(101)), {}
    for turn in range(101):
        i = turn % 3
        slot = next(s for j in range(101) if (s := (offset[i] + j * skip[i]) % 101) in free)
        free.remove(slot)
        expected[slot] = i
    assert table == [expected[s] for s in range(101)]


def test_a_lost_shard_moves_few_others():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.fill(names, 2003), sharding.fill(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.2 * 2003


@pytest.mark.parametrize("slots", [100, 1])
def test_size_has_to_be_a_prime(slots):
    with pytest.raises(ValueError):
        sharding.fill(["a"], slots)


def test_rows(spark):
    rows = [(1, "x", 7), (1, "x", 7), (None, None, 8), (2, "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, SLOT int")
    got = sharding.placed(df, "doc_id", ["a", "b"], 11)
    assert sorted(got.columns) == ["doc_id", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 4 and len({(r.slot, r.shard) for r in rows if r.doc_id == 1}) == 1
    table = sharding.fill(["a", "b"], 11)
    assert all(r.shard == "ab"[table[r.slot]] for r in rows)
    assert sharding.placed(df.limit(0), "doc_id").collect() == []
    with pytest.raises(ValueError):
        sharding.placed(df, "shard")
