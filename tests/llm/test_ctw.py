import collections
import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from levylens.llm import ctw, queries

SCHEMA = "doc_id long, text string, learns boolean, score string, n_tokens string"


def tokens(text):
    out, word = [], b""
    for byte in (text or "").encode():
        byte += 32 if 65 <= byte <= 90 else 0
        if byte == 0x20 or 9 <= byte <= 13:
            out += [word] if word else []
            word = b""
        else:
            word += bytes([byte])
    return out + ([word] if word else [])


def decisions(text, depth):
    """Per byte and bit the nodes from depth 0 on (context, bits so far), and the bit."""
    body = b" ".join(tokens(text)) + b"\n"
    padded = b"\n" * depth + body
    for i, byte in enumerate(body):
        for j in range(8):
            path = [(padded[i + depth - k : i + depth], j, byte >> (8 - j)) for k in range(depth + 1)]
            yield path, byte >> (7 - j) & 1


def brute(rows, depth):
    """{doc_id: score}: the tree is weighted by its recursive definition."""
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for _, text, learns in rows:
        if learns:
            for path, bit in decisions(text, depth):
                for above, node in zip(path, path[1:]):
                    children[above].add(node)
                for node in path:
                    counts[node][bit] += 1
    known = {}

    @functools.cache
    def kt(node):
        a, b = counts.get(node, (0, 0))
        steps = [math.log((i + 0.5)) for i in range(a)] + [math.log(i + 0.5) for i in range(b)]
        return sum(steps) - sum(math.log(i + 1) for i in range(a + b))

    @functools.cache
    def below(node):
        return sum(weight(c) for c in children.get(node, ()))

    def weight(node):
        if node not in known:
            own = kt(node)
            if len(node[0]) < depth:
                other = below(node)
                most = max(own, other)
                own = most + math.log((math.exp(own - most) + math.exp(other - most)) / 2)
            known[node] = own
        return known[node]

    out = {}
    for doc, text, _ in rows:
        total = 0
        for path, bit in decisions(text, depth):
            p = None
            for node in reversed(path):
                a = counts.get(node, (0, 0))
                estimate = (a[bit] + 0.5) / (sum(a) + 1)
                if p is None:
                    p = estimate
                else:
                    share = 1 / (1 + math.exp(min(700, below(node) - kt(node))))
                    p = share * estimate + (1 - share) * p
            total += math.log10(p)
        out[doc] = total
    return out


def made_rows():
    rng = random.Random(3)
    vocabulary = ["the", "tHere", "Ère", "of", "on", "tone", "zebra" * 3, "日本語"]
    texts = [
        rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        for _ in range(40)
    ]
    texts += [None, "", "   ", "unseen Words qx9", "x" * 700, "a b", texts[3], "longword" * 20]
    return [(i, t, i % 5 != 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_same_as_the_definition(spark, small, monkeypatch):
    if small:  # many groups, windows and rare grams and words
        for name, value in (
            ("GROUP_GRAMS", 60), ("WINDOW", 97), ("SLICE_BYTES", 300), ("HEAD_GRAMS", 40), ("HEAD_WORDS", 3),
            ("HELD_GRAMS", 50), ("HELD_WORDS", 4),
        ):
            monkeypatch.setattr(ctw, name, value)
    rows = made_rows()
    rows += [(None, "no id of the", True), (7, "repeated the", None), (7, "repeated the", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = ctw.scored(df, F.col("learns"), depth=3).collect()
    want = brute([(k, t, learns) for k, (_, t, learns) in enumerate(rows)], 3)
    learned = [t for _, t, learns in rows if learns]
    count = collections.Counter(w for t in learned for w in [*tokens(t), b"\n"])
    total, distinct = sum(count.values()), len(count)
    expected = collections.Counter()
    for k, (i, t, learns) in enumerate(rows):
        own = [*tokens(t), b"\n"]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        row = (i, learns, len(own), sum(count[w] > 0 for w in own), total, round(base, 6))
        expected[(*row, round(want[k], 6))] += 1
    found = collections.Counter(
        (r.doc_id, r.learns, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in got
    )
    assert found == expected


def test_probabilities_of_the_next_byte_add_up_to_one(spark):
    text = "the theory of the other"
    rows = [(0, text, True)] + [(i, f"the t{chr(i)}", False) for i in range(33, 65)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    counts = ctw.counted(df.select("text", F.lit(True).alias("learns")), 2)
    found = ctw.model(counts, 2).collect()
    by_context = collections.defaultdict(float)
    for r in found:
        by_context[r.gram >> 8] += 10**r.log10
    assert all(x <= 1 + 1e-9 for x in by_context.values())
    assert max(by_context.values()) > 0.5


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab", False, "", ""), (2, None, None, "", "")], SCHEMA)
    got = {r.doc_id: r for r in ctw.scored(df, F.col("learns")).collect()}
    assert got[1].train_tokens == got[1].n_known == 0
    assert got[1].score == pytest.approx(-24 * math.log10(2))
    assert got[1].base_score == got[2].base_score == 0
    assert got[2].score == pytest.approx(-8 * math.log10(2)) and got[2].n_tokens == 1


def test_empty_table(spark):
    assert ctw.scored(spark.createDataFrame([], SCHEMA), F.col("learns")).collect() == []


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1, 1.5, 7.5, 100, 1e6, 1e12])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_lookup():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 50, 5000))
    places = ctw.Lookup(keys)
    assert (places.find(keys) == np.arange(len(keys))).all()
    assert (places.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (ctw.Lookup(keys[:0]).find(keys) == -1).all()


def test_held_out_texts_are_better_coded_than_by_word_counts(spark):
    got = queries.op11_scores(spark, "/root/testdata/sf0.01").filter("held_out")
    base, score, n = got.selectExpr("sum(base_score)", "sum(score)", "count(*)").first()
    assert n > 50 and score > base
