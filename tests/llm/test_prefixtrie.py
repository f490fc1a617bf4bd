import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from levylens.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"
HEAD = lambda: F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(9))


def said(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(k))
        out.add((
            m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    turns = prefixtrie.numbered(df)
    rebuilt = prefixtrie.with_shared_heads(turns, every=5, head=HEAD(), longest=8)
    got = [tuple(r) for r in prefixtrie.trie(rebuilt, turns).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, convs):
        if rng.random() < 0.15:
            continue
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("band", [16, 2, 3])
def test_same_as_the_definition(spark, band, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BAND", band)
    monkeypatch.setattr(prefixtrie, "ID_BLOCK_BITS", 2)
    rows = made_rows(band, 60, 12)
    rows += [(None, 1, "user", "lost"), (4, None, "user", "first"), (4, None, "b", "c"), (7, 2, "user", "twice"),
             (7, 2, "user", "twice"), (7, 2, "user", "a:b"), (3_000_000_000, 1, "u", "far")]
    assert found(spark, rows) == brute(rows)


def test_long_and_hot_conversations(spark):
    """One conversation of many turns, equal ones among them, and many copies of another."""
    rows = [(5, t // 3, "user", "same") for t in range(700)]
    rows += [(10 + i, t, "user", f"copied {t}") for i in range(150) for t in range(3)]
    assert found(spark, rows, 9) == brute(rows)


def test_placeless_conversations_belong_to_the_root(spark):
    turnless = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:3]
    rows = [(c, 0, "user", "alone") for c in turnless]
    got = found(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 and r[3] == 3 and r[5] == 1 for r in got)


def test_roles_and_texts_are_told_apart(spark):
    rows = [(5, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, "", "abc"), (20, 0, None, "abc")]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 4


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_numbers_run_through_partitions(spark):
    rows = [(1, None, "u", "x")] * 50 + [(0, 3, "u", "y")] * 7 + [(2, i, "u", str(i)) for i in range(40)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(5)
    got = prefixtrie.numbered(df).groupBy("conv_id").agg(F.sort_array(F.collect_list("place")).alias("p"))
    assert {r.conv_id: r.p for r in got.collect()} == {
        c: list(range(1, n + 1)) for c, n in ((0, 7), (1, 50), (2, 40))
    }
