"""Streaming queries, run to completion and checked against the batch formula."""

from pyspark.sql import functions as F

from tapeframe.plans.prices import NEW_FETCH, generations
from tapeframe.plans.registry import query, view
from tapeframe.runtime import new_path, stage
from tapeframe.sources import tables as tb
from tapeframe.sources.driver import Market
from tapeframe.streaming import jobs

LIMIT, WINDOW = 5, 86400


LATENESS = 1  # days


@query("stream_session_candle", f"""
SELECT ticker, CAST(ts AS DATE) AS date, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
       CAST(sum(size) AS BIGINT) AS volume, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM fx_ticks) - INTERVAL {LATENESS} DAY AS closed
FROM fx_ticks GROUP BY ticker, CAST(ts AS DATE)
""")
def stream_session_candle(spark, folder):
    """Candles with a mark on those that can't change any more.  A tick of each ticker's first day comes again, at
    another price, with the last slice: it is late and changes nothing."""
    ticks = Market(spark, folder).ticks
    late = ticks.groupBy("ticker").agg(F.min("ts").alias("ts"), F.lit(1e9).alias("price"), F.min("size").alias("size"), F.lit(-1).cast("long").alias("tick_id"))
    first = late.where(F.col("ts") < ticks.agg(F.min("ts") + F.expr("interval 5 days")).scalar())
    return jobs.closed_and_open_candles(jobs.replay(ticks, "ticks", "ts", then=first.select(ticks.columns)), f"{LATENESS} day")


@query("stream_fresh_filter", """
SELECT tick_id, ticker, price FROM fx_ticks WHERE (tick_id % 20) * 100 - 250 BETWEEN -120 AND 900
""")
def stream_fresh_filter(spark, folder):
    shift = F.expr("make_dt_interval(0, 0, 0, (tick_id % 20) * 100 - 250)")
    ticks = Market(spark, folder).ticks.withColumn("seen_at", F.col("ts") + shift)
    feed = jobs.replay(ticks, "ticks", "ts")
    fresh = jobs.fresh_only(feed.stream.withWatermark("ts", "15 minutes"))
    return jobs.run_append(feed, fresh.select("tick_id", "ticker", "price"), "fresh")


@query("stream_latest_trade", """
SELECT ticker, max(ts) AS ts, arg_max(price, (ts, tick_id)) AS price, arg_max(size, (ts, tick_id)) AS size FROM fx_ticks GROUP BY ticker
""")
def stream_latest_trade(spark, folder):
    feed = jobs.replay(Market(spark, folder).ticks, "ticks", "ts")
    return jobs.run_updates(feed, jobs.latest_trades(feed.stream), ["ticker"], "latest")


@query("stream_upsert_lineage", f"""
SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.date, o.date) AS date, coalesce(n.close, o.close) AS close,
       CASE WHEN n.ticker IS NULL OR o.ticker IS NULL THEN 1 WHEN o.row_checksum = n.row_checksum AND coalesce(o.source_checksum, '') = coalesce(n.source_checksum, '') THEN 1 ELSE 2 END AS data_version
FROM gen_old o FULL JOIN gen_new n ON o.ticker = n.ticker AND o.date = n.date
""")
def stream_upsert_lineage(spark, folder):
    """The stored generation and the next fetch arrive as two micro-batches."""
    _, old, new = generations(spark, folder)
    facts = ["ticker", "date", "open", "high", "low", "close", "volume", "source", "row_checksum", "source_checksum"]
    feed = jobs.feed_of([old.select(*facts), new.select(*facts)], "bar_feed", once=True)
    return jobs.upsert_lineage(feed, NEW_FETCH, "bars").rows().select("ticker", "date", "close", "data_version")


@query("stream_upsert_removals", """
SELECT 'table' AS part, ticker, date, close FROM gen_old WHERE day(date) % 5 <> 0
UNION ALL SELECT 'log', ticker, date, close FROM gen_old WHERE day(date) % 5 = 0
""")
def stream_upsert_removals(spark, folder):
    """The stored generation arrives, then marks that every bar of some days was withdrawn; the log keeps what they held."""
    _, old, _ = generations(spark, folder)
    facts = ["ticker", "date", "open", "high", "low", "close", "volume", "source", "row_checksum", "source_checksum"]
    bars = old.select(*facts, F.lit(False).alias("removed"))
    gone = old.filter(F.dayofmonth("date") % 5 == 0).select("ticker", "date", *[F.lit(None).cast(old.schema[n].dataType).alias(n) for n in facts[2:]], F.lit(True).alias("removed"))
    table = jobs.upsert_lineage(jobs.feed_of([bars, gone], "bar_feed", once=True), NEW_FETCH, "bars")
    held = table.rows().select(F.lit("table").alias("part"), "ticker", "date", "close")
    log = table.revisions().filter("change_type = 'deleted'").select(F.lit("log").alias("part"), "ticker", "date", F.col("old_close").alias("close"))
    return held.unionByName(log)


view("quota_walk", f"""
SELECT event_id, subject, at_s, allowed, remaining, retry_after FROM (WITH RECURSIVE ev AS (
  SELECT event_id, user_id AS subject, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
walk AS (
  SELECT subject, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS at_s, CAST(0 AS BIGINT) AS started, CAST(0 AS BIGINT) AS used,
         CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS BIGINT) AS remaining, CAST(NULL AS BIGINT) AS retry_after FROM (SELECT DISTINCT subject FROM ev)
  UNION ALL
  SELECT subject, n, event_id, at_s, s, CASE WHEN u < {LIMIT} THEN u + 1 ELSE u END, u < {LIMIT}, CASE WHEN u < {LIMIT} THEN {LIMIT} - u - 1 ELSE 0 END,
         CASE WHEN u < {LIMIT} THEN 0 ELSE greatest(1, {WINDOW} - (at_s - s)) END
  FROM (SELECT w.subject, e.n, e.event_id, e.at_s, CASE WHEN w.used = 0 OR e.at_s - w.started >= {WINDOW} THEN e.at_s ELSE w.started END AS s,
               CASE WHEN w.used = 0 OR e.at_s - w.started >= {WINDOW} THEN 0 ELSE w.used END AS u
        FROM walk w JOIN ev e ON e.subject = w.subject AND e.n = w.n + 1))
  SELECT * FROM walk WHERE n > 0)
""")


@query("stream_quota", "SELECT * FROM quota_walk")
def stream_quota(spark, folder):
    rows = Market(spark, folder).table("events").select(
        "event_id", F.col("user_id").alias("subject"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"))
    return jobs.run_quota(jobs.replay(rows, "events", "at_s"), LIMIT, WINDOW)


SLICES = 3


@query("stream_live_marks", f"""
SELECT t.tick_id, t.ticker, c.num AS account, t.price * (c.num % 10 + 1 + t.slice) AS marked_value
FROM (SELECT *, CAST(floor((epoch(ts) - low) / greatest(high - low, 1.0) * ({SLICES} - 1e-6)) AS BIGINT) AS slice
      FROM fx_ticks, (SELECT epoch(min(ts)) AS low, epoch(max(ts)) AS high FROM fx_ticks)) t
JOIN (SELECT ticker, CAST(substr(ticker, 2) AS BIGINT) AS num FROM fx_companies) c ON c.ticker = t.ticker
""")
def stream_live_marks(spark, folder):
    """Positions are published anew ahead of each slice of quotes, one share larger; quotes are marked with what they find."""
    market, root = Market(spark, folder), new_path(spark, "positions")
    num = F.substring("ticker", 2, 20).cast("long")
    held = stage(market.companies.select("ticker", num.alias("account"), (num % 10 + 1).alias("quantity")), "held")
    publish = lambda number: tb.publish(held.withColumn("quantity", F.col("quantity") + number), root, "positions", str(number))
    feed = jobs.replay(market.ticks, "ticks", "ts", SLICES)
    publish(0)
    return jobs.run_live_marks(feed, root, "positions", "marks", before=lambda number: publish(number) if number else None)
