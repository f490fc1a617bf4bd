"""Bundles of tables that are replaced as a whole.

A bundle is written to a folder of its own and becomes the current one when its manifest, a small
file with the next number, appears. Who reads resolves the folder once and keeps reading it, so a
rebuild never changes tables under a reader; the newest KEPT bundles stay, older ones are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from levylens.sources import files, readers

KEPT = 2


def publish(spark: SparkSession, root: str, write: Callable[[str], None], keep: int = KEPT) -> str:
    """Let `write(folder)` fill a new folder, make it the current bundle and return it.

    Nothing is published if `write` fails; what it left behind is removed. Of two builds that end
    together both are published, one after the other.
    """
    if keep < 1:
        raise ValueError("the current bundle has to be kept")
    folder = f"{root}/bundles/{uuid.uuid4().hex}"
    try:
        write(folder)
    except BaseException:
        files.remove(spark, folder)
        raise
    name = folder.rsplit("/", 1)[1]
    while not files.write_new(spark, f"{root}/manifests/{_next(spark, root):012d}", name):
        pass  # another build has taken the number
    remove_old(spark, root, keep)
    return folder


def _manifests(spark: SparkSession, root: str) -> list[str]:
    return [n for n in files.names(spark, f"{root}/manifests") if n.isdigit()]


def _next(spark: SparkSession, root: str) -> int:
    return int(max(_manifests(spark, root), default="0")) + 1


def current(spark: SparkSession, root: str) -> str:
    """The folder of the newest bundle."""
    found = _manifests(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is published below {root}")
    return f"{root}/bundles/{files.read_text(spark, f'{root}/manifests/{found[-1]}')}"


def opened(spark: SparkSession, root: str, names: Iterable[str], part: str = "") -> dict[str, DataFrame]:
    """Tables of the newest bundle, all of the same one, from its subfolder `part`."""
    folder = current(spark, root)
    return readers.bundle(spark, f"{folder}/{part}" if part else folder, names)


def remove_old(spark: SparkSession, root: str, keep: int = KEPT) -> None:
    """Remove all published bundles but the newest `keep`; unfinished builds are left alone."""
    for manifest in _manifests(spark, root)[:-keep]:
        folder = files.read_text(spark, f"{root}/manifests/{manifest}")
        files.remove(spark, f"{root}/bundles/{folder}")
        files.remove(spark, f"{root}/manifests/{manifest}")
