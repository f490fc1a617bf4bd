import numpy as np
import pytest

from levylens.llm import langid
from levylens.llm.queries import op1_language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id % 3 <> 0")
    return langid.train(docs)


def test_held_out_accuracy(spark):
    labels = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect())
    rows = op1_language(spark, FOLDER).collect()
    assert len(rows) == len(labels)
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows) / len(rows) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_probabilities_sum_to_one(model):
    rng = np.random.default_rng(1)
    contexts = np.concatenate([model.keys[4][:50] >> np.uint32(8), rng.integers(0, 1 << 24, 50)])
    for context in contexts.astype(np.uint32):
        keys = (context << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert np.allclose(np.exp(model.log_probabilities(keys).astype(float)).sum(axis=0), 1, atol=1e-4)


def test_edges(spark, model, monkeypatch):
    monkeypatch.setattr(langid, "PART_CHARS", 1000)
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'de'").first().text
    rows = [(1, None), (2, ""), (3, "12 .!"), (4, text), (4, text), (None, text * 50),
            (6, "xq zzkj wvvq qqx kjhg " * 30), (7, "Это русский текст " * 20)]
    df = spark.createDataFrame([(i, t, 5, "old") for i, t in rows], "doc_id long, text string, SCORE int, Lang_Pred string")
    out = langid.identified(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in out.collect()]
    assert got[:6] == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False),
                       (4, "de", False), (None, "de", False)]
    assert [x[2] for x in got[6:]] == [True, True]
    assert langid.identified(df.limit(0), model).collect() == []
    none = langid.identified(df, None, keep_text=False).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a text", None), (2, None, "en"), (3, "1", "en")], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert langid.train(df.limit(0)) is None


def test_counts_are_those_of_all_texts(spark):
    rows = [("en", "Ab c"), ("en", "abc"), ("fr", "ÀB!  c")]
    got = langid.counts(spark.createDataFrame(rows, "lang string, text string"))
    own = {r.lang: {} for r in got.collect()}
    for r in got.collect():
        own[r.lang][bytes([r.gram >> s & 255 for s in (24, 16, 8, 0)])] = r.n
    a, b, c = 2, 3, 4
    assert own["en"] == {
        bytes([1, 1, 1, a]): 2, bytes([1, 1, a, b]): 2, bytes([1, a, b, 0]): 1, bytes([a, b, 0, c]): 1,
        bytes([1, a, b, c]): 1,
    }
    assert sum(own["fr"].values()) == 4


@pytest.mark.parametrize("left_out", ["de", "en"])
def test_a_language_left_out_is_rejected_at_any_length(spark, left_out):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs.filter(f"lang <> '{left_out}' and doc_id % 3 <> 0"))
    rows = docs.filter("doc_id % 3 = 0").select("lang", "text").collect()
    for size in (40, 100, 300):
        cut = [(r.lang, r.text[(len(r.text) - size) // 2 :][:size]) for r in rows if len(r.text) >= size]
        rejected = model.judged([text for _, text in cut])[2]
        other = np.array([lang == left_out for lang, _ in cut])
        assert rejected[other].mean() > 0.8, size
        assert rejected[~other].mean() < 0.05, size


def test_a_few_odd_texts_do_not_move_the_limit():
    values = np.random.default_rng(3).normal(size=400)
    odd = np.concatenate([values, [40.0, 60.0, 80.0]])
    assert abs(langid._tail(odd, 0.001) - langid._tail(values, 0.001)) < 0.5


def test_every_labelled_text_calibrates(spark, monkeypatch):
    """Whatever the ids hash to: each text and each of its cuts is scored once, without its counts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null and doc_id % 3 <> 0")
    of_one_part = docs.filter("pmod(xxhash64(doc_id, 'calibration'), 4) <> 0")
    seen = []
    own = langid.calibration
    monkeypatch.setattr(langid, "calibration", lambda rows, *more: seen.append(rows) or own(rows, *more))
    model = langid.train(of_one_part)
    assert model.mean is not None and np.isfinite(model.limit).all()
    assert model.judged(["xq zzkj wvvq qqx kjhg " * 30])[2].all()
    whole = seen[0].filter("whole").count()
    labelled = of_one_part.filter(langid.letters(of_one_part.text)).count()
    assert 0.97 * labelled <= whole <= labelled  # those predicted as labelled


def test_counts_of_bins_give_the_limits_of_all_scores(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(10, 3000, 4000)
    lang, h = rng.integers(0, 2, 4000), 2 + rng.normal(size=4000) * np.sqrt(0.01 + 2 / n)
    rows = [(int(x), bool(k % 2), int(m), float(e), -float(e), [float(1 - x), float(x), 0.0], None)
            for k, (x, m, e) in enumerate(zip(lang, n, h))]
    rows.append((None, None, None, None, None, None, [-abs(k - 4.0) for k in range(len(langid.TEMPERATURES))]))
    schema = ("lang int, whole boolean, n long, h double, fits double, shares array<double>,"
              " likelihood array<double>")  # fmt: skip
    got = langid.calibration(spark.createDataFrame(rows, schema), 3, 0.001)
    assert got["temperature"] == langid.TEMPERATURES[4]
    assert np.allclose(got["mean"][:2], 2, atol=0.01) and got["mean"][2] == np.median(got["mean"][:2])
    size = np.abs(np.log(n)[:, None] - np.log(langid.SIZES)).argmin(axis=1)
    for i in (0, 1):
        off, mine = (h - got["mean"][i]) ** 2, lang == i
        between = np.median(off[mine & (n >= np.median(n[mine]))]) * 2.2
        within = np.median((off * n)[mine]) * 2.2
        assert np.allclose(got["spread"][i], [between, within], rtol=0.02)
        excess = (h - got["mean"][i]) / np.sqrt(got["spread"][i, 0] + got["spread"][i, 1] / n)
        assert (mine & (size == 4)).sum() >= langid.ENOUGH
        assert got["limit"][i, 4] >= langid._tail(excess[mine & (size == 4)], 0.001) - 0.05
    assert got["limit"].max() < 8


def test_a_text_in_two_labelled_languages_is_not_rejected(spark, model):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id % 3 = 0 and length(text) > 600").collect()
    of = {x: [r.text[:300] for r in rows if r.lang == x] for x in ("de", "fr")}
    both = [a + " " + b for a, b in zip(of["de"], of["fr"])]
    assert len(both) >= 10
    assert model.judged(both)[2].mean() < 0.2


def test_rare_sequences_stay_in_the_model(spark):
    rows = [(i, "abcd " * 6000, "en") for i in range(400)] + [(400 + i, "wxyz", "en") for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    key = 24 << 24 | 25 << 16 | 26 << 8 | 27
    assert key in model.keys[4].tolist()


def test_lower_orders_count_contexts(spark):
    rows = [("en", 0x02030405, 9), ("en", 0x06030405, 1), ("en", 0x02070405, 2), ("fr", 0x02030405, 1)]
    out = langid.orders(spark.createDataFrame(rows, "lang string, gram long, n long")).collect()
    got = {(r.lang, r.level, r.gram): r.n for r in out}
    assert got == {
        ("en", 4, 0x02030405): 9, ("en", 4, 0x06030405): 1, ("en", 4, 0x02070405): 2,
        ("en", 3, 0x030405): 2, ("en", 3, 0x070405): 1, ("en", 2, 0x0405): 2, ("en", 1, 0x05): 1,
        ("fr", 4, 0x02030405): 1, ("fr", 3, 0x030405): 1, ("fr", 2, 0x0405): 1, ("fr", 1, 0x05): 1,
    }
