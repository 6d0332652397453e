"""Published tables of one market, for lookups that must not rebuild history.

A table is published when it is first asked for and read from its files afterwards, by every later query of any
session that uses the same root.  The root names the state of the source files, so changed sources are published anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.runtime import shared_root
from tapeframe.sources.files import exists
from tapeframe.sources.layout import Clustered, publish_clustered


def source_state(spark: SparkSession, paths: list[str]) -> str:
    """Digest of names, sizes and times of the source files; nothing in them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(
        F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    found = files.agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return f"{found.n}-{int(found.h or 0) % (1 << 64):016x}"


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: list[str], root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_root(spark) + '/store'}/{source_state(spark, [f'{folder}/{t}.parquet' for t in tables])}"

    def table(self, name: str, build: Callable[[], DataFrame], time: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> Clustered:
        path = f"{self.root}/{name}"
        if not exists(self.spark, f"{path}/current"):
            publish_clustered(build(), path, time, finish=finish)
        return Clustered(self.spark, path)
