"""Read queries over the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.signals import action_rank

MAX_LIMIT = 5000


def clamp(limit: int) -> int:
    return max(1, min(MAX_LIMIT, limit))


def rankings(signals: DataFrame, limit: int = 20, action: str | None = None) -> DataFrame:
    """Best signals; the limit is the feature, so Spark keeps a top-k per task."""
    best = [F.round("unified_score", 6).desc_nulls_last(), F.round("selection_strength", 6).desc_nulls_last(),
            F.col("ticker").asc()]
    if action == "SCREEN_BUY":
        rows, order = signals.filter("screen_action = 'BUY'"), best
    elif action:
        rows, order = signals.filter(F.col("final_action") == action), best
    else:
        rows, order = signals, [action_rank().asc(), *best]
    return rows.orderBy(*order).limit(clamp(limit))


def newest_then_ascending(rows: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows, returned oldest first."""
    return rows.orderBy(F.col("date").desc()).limit(clamp(limit)).orderBy("date")


def price_range(prices: DataFrame, ticker: str, start: str, end: str, limit: int = 1000) -> DataFrame:
    wanted = prices.filter((F.col("ticker") == ticker) & F.col("analysis_ready")
                           & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return newest_then_ascending(wanted, limit)


def newest(rows: DataFrame, ticker: str | None, time: str, limit: int, *then: str) -> DataFrame:
    """Top-k newest rows of a ticker (or of a one-ticker table); the scan sees the ticker filter."""
    wanted = rows if ticker is None else rows.filter(F.col("ticker") == ticker.strip().upper())
    return wanted.orderBy(F.col(time).desc(), *then).limit(clamp(limit))


def quotes(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """Last ready close of up to forty tickers."""
    if not 1 <= len(tickers) <= 40:
        raise ValueError("ask for 1 to 40 tickers")
    wanted = prices.filter(F.col("ticker").isin([t.strip().upper() for t in tickers]) & F.col("analysis_ready"))
    return wanted.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def per_ticker_newest(rows: DataFrame, time: str, n: int) -> DataFrame:
    from tapeframe.operators.ranking import first_per_key
    return first_per_key(rows, ["ticker"], [F.col(time).desc()], n)


def breakdown(rows: DataFrame, status: str, reason: str) -> DataFrame:
    named = F.coalesce(F.when(F.col(reason) != "", F.col(reason)), F.lit("none"))
    return rows.groupBy(F.col(status).alias("status"), named.alias("reason")).agg(F.count("*").alias("rows"))


def ticker_context(signals: DataFrame, prices: DataFrame, annual: DataFrame, quarterly: DataFrame, actions: DataFrame, peers: DataFrame,
                   companies: DataFrame, snapshots: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One nested row per ticker: signal, company, last two bars, newest annual and quarterly items, last actions, peer
    valuation, newest snapshot and the index row (``benchmark`` has one row).

    Every list is cut to its newest few rows before it is gathered.
    """
    bars = per_ticker_newest(prices, "date", 2).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("date", "close", "volume")), asc=False).alias("prices"))
    last = per_ticker_newest(actions, "ex_date", 5).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("ex_date", "action_type")), asc=False).alias("actions"))
    items = latest_period_items(annual).select("ticker", "period_end", "items")
    quarter = latest_period_items(quarterly).select("ticker", F.col("items").alias("quarter_items"))
    nested = lambda rows, name: rows.select("ticker", F.struct(*[c for c in rows.columns if c != "ticker"]).alias(name))
    out = signals
    for part in (bars, items, quarter, last, nested(peers, "peers"), nested(companies, "company"), nested(per_ticker_newest(snapshots, "as_of_utc", 1), "snapshot")):
        out = out.join(part, "ticker", "left")
    return out.withColumn("benchmark", benchmark.select(F.struct(*benchmark.columns)).scalar())


def latest_period_items(rows: DataFrame) -> DataFrame:
    """Items of each ticker's newest period as a map; of a code in several statements the last statement's value."""
    newest_end = rows.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    best = rows.join(newest_end, ["ticker", "period_end"]).groupBy("ticker", "period_end", "item_code").agg(
        F.max(F.struct("statement", "value")).alias("_v")).select("ticker", "period_end", "item_code", "_v.value")
    return best.groupBy("ticker", "period_end").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_code", "value")))).alias("items"))
