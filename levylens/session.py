"""Session settings the analyses are written for."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: broadcast what turns out small, split skewed join partitions, merge
    # small shuffle partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Join by hash instead of sorting where every partition of one side turned out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Malformed text is handled expression by expression; anything unexpected should fail.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column expression doubles planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(
    app: str = "levylens",
    extra: Mapping[str, str] | None = None,
    shared_folder: str | None = None,
) -> SparkSession:
    """The current session, or a new one with SETTINGS and `extra` on top.

    Results used twice are written below `shared_folder`, a folder that the driver and all executors
    reach (on a cluster it has to be named here or as `spark.checkpoint.dir`; a single process takes
    one of its own). `fit_shuffles` raises the number of shuffle partitions for large inputs.
    """
    builder = SparkSession.builder.appName(app)
    shared = {} if shared_folder is None else {"spark.checkpoint.dir": shared_folder}
    for key, value in {**SETTINGS, **shared, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SHUFFLE_PARTITION_BYTES = 256 * 1024 * 1024
#: Blocks are map tasks times partitions; the driver keeps a size for each.
MOST_PARTITIONS = 20_000


def fit_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Raise `spark.sql.shuffle.partitions` so that a shuffle of so many bytes fits the tasks.

    The setting is only ever raised, to MOST_PARTITIONS at most (beyond, partitions grow and spill),
    and small shuffles are coalesced at run time, so a number fit for the largest shuffle of a
    query does no harm to the others.
    """
    needed = min(MOST_PARTITIONS, -(-input_bytes // SHUFFLE_PARTITION_BYTES))
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(needed))


#: Of rows that go to Python together. Ten thousand rows, Spark's own bound, may be texts of any size,
#: and its 64 MB are held several times over: as vectors that double, by the worker, and in its answer.
BATCH_BYTES = 4 * 1024 * 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def fit_batches(spark: SparkSession) -> None:
    """Lower the bytes of the batches in which rows go to Python to BATCH_BYTES.

    A batch ends with the row that reaches the bound, so none is cut. The setting is only ever
    lowered, and like that of `fit_shuffles` not taken back.
    """
    number, unit = re.match(r"(\d+)([kmg]?)", spark.conf.get(_BATCH_SETTING).lower()).groups()
    if int(number) << 10 * " kmg".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
