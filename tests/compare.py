"""Run a registered query on Spark and its SQL on DuckDB and report the first difference."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem"
    " events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def _cell(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


SPARK_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


def difference(spark, con, name, query, sql, folder):
    start = time.time()
    df = query(spark, folder)
    rows = df.collect()
    spent = time.time() - start
    rel = con.sql(sql)
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    names_s, rows_s = _canonical(df.columns, [tuple(r) for r in rows])
    names_d, rows_d = _canonical(rel.columns, rel.fetchall())
    if names_s != names_d:
        return spent, f"{name}: columns {names_s} against {names_d}"
    for column, spark_type in df.dtypes:
        if SPARK_TYPES.get(spark_type) != types[column]:
            return spent, f"{name}: {column} is {spark_type} against {types[column]}"
    if len(rows_s) != len(rows_d):
        return spent, f"{name}: {len(rows_s)} rows against {len(rows_d)}"
    if not rows_s:
        return spent, f"{name}: no rows"
    for a, b in zip(rows_s, rows_d):
        if a != b:
            return spent, f"{name}: {a} against {b}"
    return spent, None
