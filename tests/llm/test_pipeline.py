import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from levylens.llm.queries import KNOWN_KEY, tokenizer_path
from levylens.session import BATCH_BYTES, fit_batches
from tests.llm import brute
from tests.llm.test_packing import checked


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    rng = random.Random(4)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(400).collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    texts = {r.doc_id: r.text for r in docs}
    last = max(texts)
    source = docs[5]
    planted = {
        last + 1: "qqxz wvkj zzqp " * 40,  # no language
        last + 2: docs[3].text,  # a copy
        last + 3: source.text + "\n" + items[0].text,  # contaminated
        last + 4: source.text + " mail me at Jane.Doe42@example.org",
        last + 5: None, last + 6: "",
    }
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    rows += [(i, t, None if i == last + 1 else "en", "s", len(t or "")) for i, t in planted.items()]
    rng.shuffle(rows)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{tmp_path}/benchmark.parquet")

    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near duplicates", "decontamination", "personal data", "sequences"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, f in corpus_pipeline.STAGES:
        now = f(spark, now, str(tmp_path))
        path = f"{tmp_path}/{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen.append(now)
        if name != "sequences":
            assert now.columns == corpus_pipeline.COLUMNS
    language, near, clean, private, sequences = seen

    kept = {r.doc_id: r.text for r in language.collect()}
    gone = {last + 1, last + 5, last + 6}
    assert not gone & kept.keys() and len(kept) >= len(rows) - 3 - 4
    groups = brute.near_duplicates(kept.items(), 5)
    left = {r.doc_id: r.text for r in near.collect()}
    assert left == {i: kept[i] for i, (_, root) in groups.items() if i == root}
    found = {d for d, *_ in brute.contained(left.items(), [(r.item_id, r.text) for r in items])}
    assert last + 3 not in left or last + 3 in found
    pure = {r.doc_id: r.text for r in clean.collect()}
    assert pure == {i: t for i, t in left.items() if i not in found}
    masked = {r.doc_id: (r.text, r.n_chars) for r in private.collect()}
    assert masked.keys() == pure.keys()
    assert all(n == len(t) for t, n in masked.values())
    if last + 4 in pure:
        new = brute.mail(KNOWN_KEY, "Jane.Doe42@example.org")
        assert masked[last + 4][0].endswith(f"mail me at {new}")

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, (t, _) in masked.items()}
    checked(sequences.collect(), ids)


def test_empty_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_and_missing_ids(spark, tmp_path):
    """One row of each group of duplicates stays, and an id's other texts are judged on their own."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one, two, three, four = (" ".join(word() for _ in range(60)) for _ in range(4))
    rows = [(1, one), (1, one), (1, two), (2, one + " more"), (None, two), (None, three), (3, four), (3, four + " x")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], kinds)
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(3), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (1, two), (0, three), (3, min(four, four + " x"))]) or \
        sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (1, two), (0, three), (3, four + " x")])
    spark.createDataFrame([(5, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((i or 0, t) for i, t in rows if t != two)


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 4000))
    docs = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    stages = dict(corpus_pipeline.STAGES)
    try:
        for name in ("language", "near duplicates", "decontamination", "sequences"):
            spark.conf.unset(setting)
            stages[name](spark, docs.limit(5), str(tmp_path))
            found = docs.select("doc_id", "text").mapInArrow(sizes, "n long, size long").collect()
            assert max(r["size"] for r in found) < BATCH_BYTES + 50_000, name
            assert sum(r["n"] for r in found) == 1000
        bound = str(BATCH_BYTES)
        for own, then in {"100k": "100k", "1M": "1M", "5m": bound, "1g": bound, "9000000b": bound}.items():
            spark.conf.set(setting, own)
            fit_batches(spark)
            assert spark.conf.get(setting).removesuffix("b") == then
    finally:
        spark.conf.unset(setting)
