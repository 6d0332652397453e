"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a hash-drawn score, weighted as -ln(u) / weight, and a record goes to the shard with
the least one.  A new shard changes no score of the old ones, so records move only into it.  Scores are column
expressions; placing needs no shuffle.  Slots number the records of a shard without putting a shard into one task:
rows are counted by (input partition, shard), the counts are summed up along the partitions, and rows are numbered
within those small groups.

Defined results: a null key is a key like any other (all null keys share a shard), a null text counts no bytes,
repeated rows share the shard and get slots of their own, other columns are not read, an empty table stays empty.
Equal texts under different keys may be placed apart: the key and the shards alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage

UNIT_BITS = 53


def pair_score(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw with rate ``weight``; 53 bits of the hash make u, which is never 0."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 64 - UNIT_BITS)
    return -F.log((bits.cast("double") + 0.5) / float(1 << UNIT_BITS)) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key; ties go to the smaller number, shards of weight 0 win nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be at least 0, and one of them above")
    scores = [F.struct(pair_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_slots(placed: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each shard.  The frame is written once, so numbering sees fixed partitions."""
    columns = placed.columns
    fixed = stage(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "shards")
    running = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = fixed.groupBy("__part", shard).count().withColumn("__before", F.coalesce(F.sum("count").over(running), F.lit(0))).drop("count")
    within = Window.partitionBy("__part", shard).orderBy("__at")
    return (fixed.withColumn("__n", F.row_number().over(within))
            .join(before, ["__part", shard])
            .select(*columns, (F.col("__before") + F.col("__n") - 1).cast("long").alias(slot)))


def place(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None,
          new_weight: float = 1.0, overhead: int = 8) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard (with one more shard), slot; one row for each row of docs."""
    weights = weights or [1.0] * shards
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), [*weights, new_weight]).alias("grown_shard"))
    return with_slots(placed)
