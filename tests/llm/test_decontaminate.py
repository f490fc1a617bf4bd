import random

from levylens.llm import decontaminate
from tests.llm import brute


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return decontaminate.contained_items(docs, items)


def test_same_as_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 70)), 0) for i in range(40)] + [(99, None, 0), (98, "", 0)]
    docs = []
    for d in range(120):
        parts = [text(rng.choice([0, 3, 50, 400]))]
        for _, item, _ in rng.sample(items[:40], rng.randint(0, 3)):
            kept = item.split()
            for _ in range(rng.randint(0, 3)):
                kept[rng.randrange(len(kept))] = "changed"
            half = rng.randint(0, len(kept))
            parts += [" ".join(kept[:half]), text(rng.choice([0, 0, 300])), " ".join(kept[half:]).upper()]
        docs.append((d, " ".join(parts)))
    docs += [(200, None), (201, ""), (None, docs[0][1]), (202, text(20_000) + " " + items[7][1]),
             (203, items[3][1])]
    expected = brute.contained([d for d in docs if d[0] is not None], [i[:2] for i in items])
    assert len(expected) > 40
    assert {tuple(r) for r in run(spark, docs, items).collect()} == expected
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 100)  # several blocks
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    assert {tuple(r) for r in run(spark, docs, items).collect()} == expected


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e", 0)]).collect() == []
    assert run(spark, [(1, "a b c d e")], []).collect() == []


def test_only_the_search_runs_python(spark):
    """A table made of Python rows would be read by Python processes besides those of the search."""
    docs = spark.range(3).selectExpr("id AS doc_id", "'a b c d e f' AS text")
    items = spark.range(2).selectExpr("id AS item_id", "'a b c d e' AS text")
    found = decontaminate.contained_items(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ExistingRDD" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(d, i, 1, 1) for d in range(3) for i in range(2)]
    none = decontaminate.contained_items(docs, items.limit(0))
    assert none.dtypes == found.dtypes and none.collect() == []


def test_repeated_rows(spark):
    docs = [(1, "a b c d e f g")] * 2
    got = run(spark, docs, [(4, "A b c d e f", 0)] * 2).collect()
    assert [tuple(r) for r in got] == [(1, 4, 2, 2)] * 2


def test_words_that_collide_under_polynomial_hashes(spark):
    a, b = brute.colliding_words()
    assert [r.doc_id for r in run(spark, [(1, a), (2, b)], [(4, a, 0)]).collect()] == [1]
