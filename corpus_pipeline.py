"""From raw documents to packed training sequences, in stages.

Each stage is a function of (spark, docs, folder): it gets what the stage before kept, in the
columns of `documents`, and returns a table; `run` writes each result as Parquet in the shared
folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from levylens.llm import decontaminate, langid, minhash, packing, pii
from levylens.llm.queries import pii_key, table, tokenizer_path
from levylens.session import fit_batches
from levylens.sources.sinks import staged

#: The columns of `documents`; any others go.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for every row: the id, or where ids are repeated or missing a
    new number, stored with the rows."""
    own = docs.select(*COLUMNS)
    ids = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        return own.withColumn("row", F.col("doc_id"))
    return staged(own.withColumn("row", F.monotonically_increasing_id()), "keyed")


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in none of the labelled languages go; all labelled documents are learned from."""
    fit_batches(spark)
    found = langid.identified(docs, langid.train(docs))
    return found.filter("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    fit_batches(spark)
    rows = keyed(docs)
    found = minhash.near_duplicates(rows, words=5, similarity_percent=80, id_col="row")
    members = found.select(F.col("doc_id").alias("row"), "component_id")
    named = rows.select("row", "doc_id").join(members, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    kept = named.groupBy("component_id").agg(first).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    fit_batches(spark)
    rows = keyed(docs)
    found = decontaminate.contained_items(rows, table(spark, folder, "benchmark"), id_col="row")
    dropped = found.select(F.col("doc_id").alias("row")).distinct()
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data is replaced by pseudonyms; all documents stay."""
    out = pii.pseudonymised(docs, pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the training sequences that the documents are packed into."""
    fit_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sequences", sequences),
]

ORACLE_SQL = None  # language identification and tokens are not SQL


def run(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "documents")
    for name, stage in STAGES:
        out = staged(stage(spark, out, folder), name.replace(" ", "-"))
    return out
