from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from levylens.functions._column import col, quoted, unused
from levylens.sources import files as storage


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write the rows into a table partitioned by a column. The values of that column that occur
    in the rows have their partitions replaced, all other partitions stay as they are.

    The rows of a value are dealt to the partition's tasks in one shuffle, by size.
    """
    dealt = df.hint("rebalance", quoted(by))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


#: Bytes of a row group of clustered tables: small, so that a picked value is in few of them.
ROW_GROUP = 4 * 1024 * 1024


def save_clustered(
    df: DataFrame, path: str, by: Sequence[str], bloom: Sequence[str] = (), row_group: int = ROW_GROUP
) -> None:
    """A table laid out for picking rows by the values of some columns.

    Rows are range-partitioned and sorted by the columns, so that the minima and maxima in the
    Parquet files rule out all row groups but those that hold a picked value; `bloom` columns get
    Bloom filters for values in the middle of a range. Equal rows are dealt over tasks by a salt.
    """
    (salt,) = unused(df.columns, "salt")
    order = [*[col(c) for c in by], F.col(salt)]
    dealt = df.withColumn(salt, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop(salt)
    writer = dealt.write.mode("overwrite").option("parquet.block.size", row_group)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def save_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, path: str | None = None) -> None:
    """A catalog table whose rows are dealt to buckets by the columns and sorted in them.

    Joins of two such tables on these columns, with equally many buckets, and sums by them (or by
    more columns) read the buckets as they are: no row is shuffled. Each bucket is one file, as one
    task writes it.
    """
    keys = [col(c) for c in by]
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)


def save_pages(df: DataFrame, path: str, rows_per_page: int = 1000) -> None:
    """The open-data portal's format: files that hold a JSON array of so many objects each."""
    (page,) = unused(df.columns, "page")
    number = F.floor(F.monotonically_increasing_id() / rows_per_page)
    rows = F.collect_list(F.struct(*[col(c) for c in df.columns]))  # a page's, by parameter
    pages = df.withColumn(page, number).groupBy(page).agg(F.to_json(rows).alias("value"))
    pages.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def save_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    """One Parquet directory per named table."""
    for name, df in tables.items():
        save_table(df, f"{root}/{name}")


def export_csv(df: DataFrame, root: str, on: datetime.date | None = None) -> str:
    """Write `data-<date>.csv` with a header below `root` and return its path."""
    path = f"{root}/data-{on or datetime.date.today()}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_ordered(
    df: DataFrame, path: str, order: Sequence[Column], files: int | None = None
) -> None:
    """CSV files that hold the rows in order when read by name, one after the other.

    The rows are range-partitioned by bounds sampled from the whole order and sorted within their
    file. Rows that are equal in the order, however many, are dealt over files by their place in the
    input, so a frequent value makes no file larger than others.
    """
    (salt,) = unused(df.columns, "salt")
    wanted = [*order, F.col(salt)]
    dealt = df.withColumn(salt, F.monotonically_increasing_id())
    number = [] if files is None else [files]
    dealt = dealt.repartitionByRange(*number, *wanted).sortWithinPartitions(*wanted).drop(salt)
    dealt.write.mode("overwrite").option("header", True).csv(path)


def export_sheets(sheets: Mapping[str, DataFrame], root: str) -> None:
    """One CSV directory per sheet name."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The table written to the shared folder and read back. Runs a job.

    For results used twice: reading the copy neither repeats the work nor depends on the executors
    that did it. And for per-group results joined back to the rows they come from: the planner
    knows the bytes of a stored table, so it broadcasts a small one and leaves the rows where they
    are. An aggregate it can only take to be as large as its input, and it would start to shuffle
    the rows before finding out.
    """
    path = shared_folder(df.sparkSession, purpose)
    save_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below the session's `spark.checkpoint.dir`. It is
    removed when the session's process ends.

    A machine-local folder is used only where no folder is named and Spark runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="levylens-")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    storage.remove_at_end(spark, path)
    return path
