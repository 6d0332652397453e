"""Published tables laid out for lookups: rows clustered by ticker and time, and an index of what each file holds.

Files are cut by range on (ticker, time), so a ticker with a third of all rows spreads over many files and small ones
share a file.  The index has a row for each (file, ticker): rows and first and last time.  A lookup asks the index,
and only the files it names are opened.  A new version is written beside the old one and becomes current by one
replaced pointer; a reader that has started keeps its version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage
from tapeframe.sources.files import read_pointer, replace_pointer

FILE_ROWS = 2_000_000


def publish_clustered(rows: DataFrame, root: str, time: str, key: str = "ticker", file_rows: int = FILE_ROWS,
                      finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a version of the table with its index and make it the current one.

    ``finish`` adds what follows from a row by itself; it works on rows that are in their place, so only what it starts
    from is staged and moved.
    """
    spark, version = rows.sparkSession, f"{root}/{uuid.uuid4().hex}"
    order = [F.col(key), F.col(time)]
    rows = stage(rows, "unsorted")  # the ranges are sampled first, which would run the plan behind rows twice
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged if finish is None else finish(ranged)
    ranged.write.option("maxRecordsPerFile", file_rows).parquet(f"{version}/rows", compression="zstd")
    written = spark.read.schema(ranged.schema).parquet(f"{version}/rows")
    index = written.groupBy(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key")).agg(
        F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))
    index.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{version}/index", compression="zstd")
    replace_pointer(spark, f"{root}/current", version)


class Clustered:
    """The current version of a published table."""

    def __init__(self, spark: SparkSession, root: str, key: str = "ticker"):
        self.spark, self.key, self.version = spark, key, read_pointer(spark, f"{root}/current")
        if self.version is None:
            raise FileNotFoundError(f"nothing is published under {root}")

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.version}/rows")

    @cached_property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.version}/index")

    def _files(self, entries: DataFrame, keys: list[str] | None) -> DataFrame:
        """Rows of the keys in the files named; their number is that of the files of the keys asked for."""
        files = [r.file for r in entries.select("file").distinct().collect()]
        found = self.spark.read.schema(self.rows.schema).parquet(*files) if files else self.rows.limit(0)
        return found if keys is None else found.where(F.col(self.key).isin(keys))

    def of(self, keys: list[str], first=None, last=None) -> DataFrame:
        """All rows of the keys between two times, both included."""
        entries = self.index.where(F.col("key").isin(keys))
        entries = entries if first is None else entries.where(F.col("last") >= F.lit(first))
        entries = entries if last is None else entries.where(F.col("first") <= F.lit(last))
        return self._files(entries, keys)

    def newest(self, keys: list[str] | None, n: int) -> DataFrame:
        """Rows of each key (None: of all) that hold its n newest ones: files from the latest back until n rows are covered.

        Files of a key follow each other in time, so rows of equal time at a border are kept by covering n strictly
        later ones first.
        """
        later = Window.partitionBy("key").orderBy(F.col("first").desc(), F.col("last").desc(), "file").rowsBetween(Window.unboundedPreceding, -1)
        asked = self.index if keys is None else self.index.where(F.col("key").isin(keys))
        entries = asked.withColumns({"covered": F.coalesce(F.sum("rows").over(later), F.lit(0)), "from": F.min("first").over(later)})
        return self._files(entries.where((F.col("covered") < n) | (F.col("last") >= F.col("from"))), keys)

    def keys(self) -> DataFrame:
        """rows, first and last time of every key, from the index alone."""
        return self.index.groupBy(F.col("key").alias(self.key)).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
