"""Compare every registered query with its SQL: python tests/run_parity.py FOLDER [NAME ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

if __name__ == "__main__":
    folder, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)), sorted(set(sql) - set(queries)))
    bad = 0
    for name in names or sql:
        try:
            spent, problem = difference(spark, con, name, queries[name], sql[name], folder)
        except Exception as error:  # report and go on with the other queries
            spent, problem = 0.0, f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"{spent:6.2f}s  {problem or name + ' ok'}", flush=True)
    print(f"{bad} of {len(names or sql)} differ")
