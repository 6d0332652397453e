"""Orderings and medians over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage


def global_row_number(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n over the whole frame without sending it to one task.

    Rows are range-partitioned on the order and staged, each partition numbers its
    own rows, and the few partition sizes give the offsets.  ``order`` must be total.
    """
    ranged = stage(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, (F.row_number().over(within) + F.col("_offset")).cast("long"))
        .drop("_part", "_offset")
    )


def first_per_key(frame: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key.

    Spark prunes to n rows per key before the shuffle, so a key with very many
    copies ships at most n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def grouped_median(frame: DataFrame, group: list[str], value: str, name: str = "median", positive: bool = True) -> DataFrame:
    """Exact median per group, of the positive values or of all.

    Values are counted, the counts are summed in narrow geometric bins, and only
    the one or two bins that hold the middle ranks are looked at value by value, so
    a group with a third of all rows is never gathered.
    """
    counts = frame.filter(F.col(value) > 0 if positive else F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    size = F.floor(F.log(F.abs("_v")) * 64) + 100_000  # above 0 for every double
    counts = counts.withColumn("_bin", F.when(F.col("_v") == 0, 0).otherwise(F.signum("_v").cast("long") * size))
    bins = counts.groupBy(*group, "_bin").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*group)
    run = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns({"_end": F.sum("_bn").over(run), "_all": F.sum("_bn").over(w)})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    start = F.col("_end") - F.col("_bn")
    middle = bins.filter((F.col("_end") >= low) & (start < high)).select(
        *group, "_bin", start.alias("_start"), low.alias("_low"), high.alias("_high"))
    inside = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(middle, [*group, "_bin"]).withColumn("_to", F.sum("_n").over(inside) + F.col("_start"))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_from") < F.col(rank)) & (F.col("_to") >= F.col(rank)), F.col("_v")))

    return ranked.groupBy(*group).agg(((at("_low") + at("_high")) / 2).alias(name))
