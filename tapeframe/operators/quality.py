"""Counts, coverage and assertions over the published tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.functions.numeric import is_true


def as_rows(frame: DataFrame, dataset: str, checks: dict[str, Column]) -> DataFrame:
    """One aggregation over the dataset, returned as (dataset, check, value) rows."""
    totals = frame.agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k), F.lit(0)).alias("value")) for k in checks])
    return totals.select(F.lit(dataset).alias("dataset"), F.explode(pairs).alias("p")).select("dataset", "p.check", "p.value")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def repeated(frame: DataFrame, keys: list[str]) -> Column:
    """Number of keys that occur more than once, as a scalar subquery."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*")).scalar()


def financial_stats(rows: DataFrame, critical: list[str]) -> DataFrame:
    """Per ticker: periods, missing shares, duplicates and the required items it lacks."""
    keys = ["ticker", "statement", "report_period", "period_type", "item_code"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), count_if(F.col("value").isNull()).alias("nulls"),
                                    count_if(F.col("published_date").isNull()).alias("undated"))
    # Distinct item codes of a ticker are at most the dictionary's length.
    per = cells.groupBy("ticker").agg(
        F.count_distinct("report_period").alias("periods"), F.sum("n").alias("_rows"), F.sum("nulls").alias("_nulls"),
        F.sum("undated").alias("_undated"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.collect_set("item_code").alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in critical]), "_have"))
    return per.select("ticker", "periods", "duplicate_rows",
                      F.round(F.col("_nulls") / F.col("_rows") * 100 + 1e-9, 2).alias("missing_percent"),
                      F.round(F.col("_undated") / F.col("_rows") * 100 + 1e-9, 2).alias("undated_percent"),
                      F.array_join(missing, ",").alias("missing_critical"), F.size(missing).alias("missing_count"))


def price_stats(rows: DataFrame) -> DataFrame:
    raw = ("open", "high", "low", "close", "volume")
    gaps = sum((F.avg(F.col(n).isNull().cast("double")) for n in raw), F.lit(0.0)) / len(raw)
    return rows.groupBy("ticker").agg(
        F.count("*").alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.round(gaps * 100 + 1e-9, 2).alias("missing_percent"),
        (F.count("*") - F.count_distinct("date")).alias("duplicate_rows"))


def dataset_status(present: Column, missing: Column, threshold: int = 0) -> Column:
    return F.when(~present, "MISSING").when(missing <= threshold, "OK").otherwise("PARTIAL")


def assertion(name: str, value: Column, low: int = 0, high: int = 0) -> Column:
    """A named count with whether it stays within its bounds."""
    return F.struct(F.lit(name).alias("check"), value.cast("long").alias("value"), is_true(value.between(low, high)).alias("passed"))


def refetch_reasons(universe: DataFrame, changed: DataFrame, audit: DataFrame, restated: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """First reason of each ticker for fetching its history again; the inputs hold a ticker and a true flag of their name.

    A restatement counts only if nothing of it is unconfirmed; otherwise the ticker is held back until it is.
    """
    out = universe
    for part in (changed, audit, restated, unconfirmed):
        out = out.join(part, "ticker", "left")
    reason = (F.when(F.col("changed"), "corporate_action_changed").when(F.col("audit"), "scheduled_history_audit")
              .when(F.col("restated") & F.col("open").isNull(), "confirmed_source_restatement"))
    return out.select("ticker", reason.alias("reason"), is_true(reason.isNull() & F.col("restated")).alias("held_back"))
