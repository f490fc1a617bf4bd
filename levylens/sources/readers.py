from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from levylens.functions._column import col
from levylens.sources import files


#: The text of a page that could not be read.
BROKEN_PAGE = "_broken_page"


def open_data(
    spark: SparkSession,
    path: str,
    schema: StructType,
    one_array_per_file: bool = True,
    mark_broken: bool = False,
) -> DataFrame:
    """Staged pages of an open-data table: JSON arrays of objects, or one object per line.

    An array file is read by one task, so stage bounded pages; line-delimited files are split. A
    page (or line) that is no JSON is a row of missing values; with `mark_broken` its text stands in
    a column BROKEN_PAGE, which is missing for all other rows (`warnings.parsed` counts it).
    """
    reader = spark.read.option("multiLine", one_array_per_file)
    if mark_broken:
        schema = StructType([*schema.fields, StructField(BROKEN_PAGE, StringType())])
        reader = reader.option("columnNameOfCorruptRecord", BROKEN_PAGE)
    return reader.schema(schema).json(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_SCHEMAS: dict[tuple, StructType] = {}
MOST_SCHEMAS = 256


def table_again(spark: SparkSession, path: str) -> DataFrame:
    """A table that is opened often. Its schema is read by a job the first time, and again when the
    time or size of its files has changed."""
    key = path, *files.stamp(spark, path)
    if key not in _SCHEMAS:
        if len(_SCHEMAS) >= MOST_SCHEMAS:
            _SCHEMAS.clear()
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def bundle(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several tables by name, one Parquet directory each."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def dimension_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def counties_of(boundaries: DataFrame, state_prefix: str = "36") -> DataFrame:
    """GEOID, county and geometry of one state; the prefix test reaches the Parquet scan."""
    return boundaries.where(col("GEOID").startswith(state_prefix)).select(
        "GEOID", F.col("NAME").alias("county"), "geometry"
    )
