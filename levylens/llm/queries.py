"""The operators on the tables of a folder, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from levylens.llm import (
    ctw,
    decontaminate,
    html,
    langid,
    minhash,
    packing,
    pii,
    prefixtrie,
    secrets,
    sharding,
    topk,
    urlfilter,
    vectorcodes,
)
from levylens.sources.sinks import staged

Query = Callable[[SparkSession, str], DataFrame]
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The setting that names the key of pseudonyms; where it is unset, a key that everyone knows is
#: used, which serves to show and test the operator only.
PII_KEY_SETTING, KNOWN_KEY = "spark.levylens.pii.key", "levylens corpus"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_SETTING, KNOWN_KEY)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    dealt = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4))
    held_out = F.coalesce(dealt == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identified(texts, model, keep_text=False)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = pii.pseudonymised(docs, pii_key(spark), findings_col="findings")
    return out.select("doc_id", "text", *[_number_of(kind) for kind in pii.KINDS])


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    out = html.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.placed(docs, "doc_id").select("doc_id", F.col("slot").cast("long"), "shard")


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    out = urlfilter.judged(table(spark, folder, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=4)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contained_items(docs, items)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = secrets.findings(docs, secrets.train(docs))

    def spans(found: Column) -> Column:
        text = F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
        return F.array_join(text, ",")

    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.KINDS))
    return out.select(
        "doc_id",
        *[_number_of(kind) for kind in secrets.KINDS],
        F.sha2(spans(base), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
    )


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    dealt = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(10))
    docs = docs.withColumn("held_out", F.coalesce(dealt == 0, F.lit(False)))
    return ctw.scored(docs, ~F.col("held_out"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefixtrie.numbered(table(spark, folder, "conversations"))
    head = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(9))
    rebuilt = prefixtrie.with_shared_heads(turns, every=5, head=head, longest=8)
    return prefixtrie.trie(rebuilt, turns)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    books = vectorcodes.train(vectors)
    coded = staged(vectorcodes.encoded(vectors, books), "codes")
    return vectorcodes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_language,
            op2_packing,
            op3_pii,
            op4_main_text,
            op5_sharding,
            op6_url_rules,
            op7_near_duplicates,
            op8_decontamination,
            op9_secrets,
            op10_top_k,
            op11_scores,
            op12_prefix_trie,
            op13_vector_codes,
        )
    }
