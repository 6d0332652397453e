"""Indicator and as-of queries."""

from pyspark.sql import functions as F

from tapeframe.operators import asof, windows as w
from tapeframe.plans.registry import query, view
from tapeframe.sources.driver import Market

W = "OVER (PARTITION BY ticker ORDER BY date"


def sql_rolling(fn: str, column: str, n: int, upto: int = 0) -> str:
    frame = f"{W} ROWS BETWEEN {n - 1 + upto} PRECEDING AND {upto or 'CURRENT ROW'}{' PRECEDING' if upto else ''})"
    return f"CASE WHEN count({column}) {frame} = {n} THEN {fn}({column}) {frame} END"


@query("sma_20_50_100_200", f"""
SELECT ticker, date, {', '.join(f"round({sql_rolling('avg', 'close', n)}, 4) AS ma{n}" for n in (20, 50, 100, 200))}
FROM fx_bars
""")
def sma(spark, folder):
    out = w.moving_averages(Market(spark, folder).bars, "close")
    return out.select("ticker", "date", *[F.round(f"ma{n}", 4).alias(f"ma{n}") for n in (20, 50, 100, 200)])


@query("prior_high_20_60", f"""
SELECT ticker, date, {sql_rolling('max', 'close', 20, 1)} AS high_close20,
       {sql_rolling('max', 'close', 60, 1)} AS high_close60 FROM fx_bars
""")
def prior_high(spark, folder):
    return w.prior_highs(Market(spark, folder).bars, "close").select("ticker", "date", "high_close20", "high_close60")


@query("volume_ratio", f"""
SELECT ticker, date, round(volume / nullif({sql_rolling('avg', 'volume', 20, 1)}, 0), 6) AS volume_ratio FROM fx_bars
""")
def volume_ratio(spark, folder):
    return w.volume_ratio(Market(spark, folder).bars).select(
        "ticker", "date", F.round("volume_ratio", 6).alias("volume_ratio"))


@query("avg_trading_value_20", f"""
SELECT ticker, date, round({sql_rolling('avg', 'trading_value', 20, 1)}, 4) AS avg_trading_value20 FROM fx_bars
""")
def avg_trading_value(spark, folder):
    return w.average_trading_value(Market(spark, folder).bars).select(
        "ticker", "date", F.round("avg_trading_value20", 4).alias("avg_trading_value20"))


@query("volatility_20", f"""
SELECT ticker, date, round({sql_rolling('stddev_pop', 'r', 20)}, 8) AS volatility20
FROM (SELECT ticker, date, close / lag(close) {W}) - 1 AS r FROM fx_bars)
""")
def volatility(spark, folder):
    return w.volatility(Market(spark, folder).bars, "close").select(
        "ticker", "date", F.round("volatility20", 8).alias("volatility20"))


@query("bollinger", f"""
SELECT ticker, date, round(m, 4) AS middle, round(m + 2 * s, 4) AS upper, round(m - 2 * s, 4) AS lower
FROM (SELECT ticker, date, {sql_rolling('avg', 'close', 20)} AS m, {sql_rolling('stddev_pop', 'close', 20)} AS s
      FROM fx_bars)
""")
def bollinger(spark, folder):
    out = w.bollinger(Market(spark, folder).bars, "close")
    return out.select("ticker", "date", *[F.round(c, 4).alias(c) for c in ("middle", "upper", "lower")])


@query("rsi_wilder", f"""
WITH moves AS (SELECT ticker, date, row_number() {W}) - 1 AS i, close - lag(close) {W}) AS d FROM fx_bars),
seeded AS (SELECT ticker, date, i, CASE WHEN i > 0 THEN greatest(d, 0.0) END AS g,
                  CASE WHEN i > 0 THEN greatest(-d, 0.0) END AS l FROM moves),
smoothed AS (
  SELECT ticker, date, i,
         sum(CASE WHEN i <= 14 THEN g ELSE g * pow(14.0 / 13.0, i - 14) END) {W}) AS gs,
         sum(CASE WHEN i <= 14 THEN l ELSE l * pow(14.0 / 13.0, i - 14) END) {W}) AS ls FROM seeded)
SELECT ticker, date, round(CASE WHEN ls = 0 AND gs = 0 THEN 50.0 WHEN ls = 0 THEN 100.0
                          ELSE 100.0 - 100.0 / (1.0 + gs / ls) END, 6) AS rsi
FROM smoothed WHERE i >= 14
""")
def rsi(spark, folder):
    return w.rsi_wilder(Market(spark, folder).bars, "close").withColumn("rsi", F.round("rsi", 6))


view("fx_price_rows", f"""
SELECT *, close AS adjusted_close,
       (low <= least(open, close, high) AND high >= greatest(open, close, low)) AS analysis_ready
FROM (SELECT ticker, date, open, CASE WHEN day(date) = 13 THEN low ELSE high END AS high,
             CASE WHEN day(date) = 13 THEN high ELSE low END AS low, close,
             CASE WHEN day(date) <> 17 THEN volume END AS volume, trading_value FROM fx_bars)
""")
view("fx_prev_valid", f"""
SELECT p.*, v.previous_price_date, v.c / v.pc - 1 AS return_prev_session, ln(v.c / v.pc) AS log_return_prev_session,
       date_diff('day', v.previous_price_date, p.date) AS return_gap_calendar_days
FROM fx_price_rows p LEFT JOIN (
  SELECT ticker, date, adjusted_close AS c, lag(adjusted_close) {W}) AS pc, lag(date) {W}) AS previous_price_date
  FROM fx_price_rows WHERE analysis_ready AND adjusted_close > 0 AND volume > 0) v
  ON p.ticker = v.ticker AND p.date = v.date
""")


def price_rows(market: Market, bars=None):
    """Bars with some broken ones: high and low swapped on the 13th, no volume on the 17th."""
    bars = bars if bars is not None else market.bars
    day = F.dayofmonth("date")
    out = bars.select(
        "ticker", "date", "open", F.when(day == 13, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(day == 13, F.col("high")).otherwise(F.col("low")).alias("low"), "close",
        F.when(day != 17, F.col("volume")).alias("volume"), "trading_value")
    return out.withColumns({
        "adjusted_close": F.col("close"),
        "analysis_ready": (F.col("low") <= F.least("open", "close", "high"))
        & (F.col("high") >= F.greatest("open", "close", "low"))})


@query("prev_valid_return", """
SELECT ticker, date, previous_price_date, return_gap_calendar_days,
       return_prev_session, round(log_return_prev_session, 8) AS log_return_prev_session FROM fx_prev_valid
""")
def prev_valid_return(spark, folder):
    return w.prev_valid_returns(price_rows(Market(spark, folder))).select(
        "ticker", "date", "previous_price_date", "return_gap_calendar_days", "return_prev_session",
        F.round("log_return_prev_session", 8).alias("log_return_prev_session"))


view("fx_sessions", "SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM fx_bars)")


@query("session_ordinal", "SELECT date, session FROM fx_sessions")
def session_ordinal(spark, folder):
    return w.session_ordinals(Market(spark, folder).bars)


view("fx_strict", """
SELECT p.*, a.session - b.session AS return_gap_trading_sessions
FROM fx_prev_valid p LEFT JOIN fx_sessions a ON p.date = a.date
LEFT JOIN fx_sessions b ON p.previous_price_date = b.date
""")


def strict(market: Market):
    ordinals = w.session_ordinals(market.staged_bars)
    return w.strict_session_returns(w.prev_valid_returns(price_rows(market, market.staged_bars)), ordinals)


@query("join_session_numbers", """
SELECT ticker, date, previous_price_date, return_gap_trading_sessions FROM fx_strict
""")
def join_session_numbers(spark, folder):
    return strict(Market(spark, folder)).select(
        "ticker", "date", "previous_price_date", "return_gap_trading_sessions")


@query("strict_session_return", """
SELECT ticker, date, CASE WHEN return_gap_trading_sessions = 1 THEN return_prev_session END AS return_1d,
       round(CASE WHEN return_gap_trading_sessions = 1 THEN log_return_prev_session END, 8) AS log_return_1d
FROM fx_strict
""")
def strict_session_return(spark, folder):
    return strict(Market(spark, folder)).select(
        "ticker", "date", "return_1d", F.round("log_return_1d", 8).alias("log_return_1d"))


def sql_bm_ma(n: int) -> str:
    frame = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {frame} = {n} THEN avg(close) {frame} END"


view("fx_bm", f"""
SELECT date, close AS bm_px, {', '.join(f'{sql_bm_ma(n)} AS bm_ma{n}' for n in (50, 100, 200))} FROM fx_benchmark
""")


@query("market_regime", """
SELECT date, bm_px, round(bm_ma50, 6) AS bm_ma50, coalesce(bm_px >= bm_ma50, false) AS market_bull FROM fx_bm
""")
def market_regime(spark, folder):
    market = Market(spark, folder)
    panel = asof.benchmark_panel(market.benchmark, market.benchmark, (50,))
    return panel.select("date", "bm_px", F.round("bm_ma50", 6).alias("bm_ma50"),
                        F.coalesce(F.col("bm_px") >= F.col("bm_ma50"), F.lit(False)).alias("market_bull"))


def sql_grown(column: str, k: int) -> str:
    base = f"last_value({column}) {W} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {k} MONTH PRECEDING)"
    return f"CASE WHEN {base} > 0 THEN {column} / {base} - 1 END"


view("fx_returns", f"""
SELECT ticker, date, {sql_grown('close', 3)} AS r3, {sql_grown('close', 6)} AS r6, {sql_grown('close', 12)} AS r12,
       {sql_grown('bm_px', 6)} AS bm_r6
FROM (SELECT b.ticker, b.date, b.close, m.bm_px FROM fx_bars b JOIN fx_bm m USING (date))
""")


def returns_panel(market: Market, bars):
    panel = asof.benchmark_panel(market.staged_benchmark, bars)
    return asof.calendar_returns(asof.with_index(bars.withColumn("px", F.col("close")), panel))


@query("asof_calendar_return", "SELECT ticker, date, r3, r6, r12, bm_r6, r6 - bm_r6 AS rs6 FROM fx_returns")
def asof_calendar_return(spark, folder):
    market = Market(spark, folder)
    return returns_panel(market, market.staged_bars).select("ticker", "date", "r3", "r6", "r12", "bm_r6", "rs6")


# An index that pauses in every third month, so dates without an index bar occur.
view("fx_bm_gaps", f"SELECT * FROM fx_bm WHERE month(date) % 3 <> 0")


@query("asof_ffill_benchmark", """
SELECT b.ticker, b.date, m.bm_px, m.bm_px IS NOT NULL AND m.date = b.date AS is_session
FROM fx_bars b ASOF LEFT JOIN
     (SELECT date, close AS bm_px FROM fx_benchmark WHERE month(date) % 3 <> 0) m ON b.date >= m.date
""")
def asof_ffill_benchmark(spark, folder):
    market = Market(spark, folder)
    bars = market.staged_bars
    sparse = market.staged_benchmark.filter(F.month("date") % 3 != 0)
    panel = asof.benchmark_panel(sparse, bars, ())
    return bars.join(panel, "date", "left").select("ticker", "date", "bm_px", "is_session")


@query("join_common_dates", """
SELECT b.ticker, b.date, b.close, m.close AS bm_px FROM fx_bars b
JOIN fx_benchmark m ON b.date = m.date AND month(m.date) % 3 <> 0
""")
def join_common_dates(spark, folder):
    market = Market(spark, folder)
    sparse = market.staged_benchmark.filter(F.month("date") % 3 != 0).select("date", F.col("close").alias("bm_px"))
    return market.staged_bars.join(sparse, "date").select("ticker", "date", "close", "bm_px")


@query("intersect_dates", """
SELECT DISTINCT ticker, date FROM fx_bars WHERE date IN (SELECT date FROM fx_benchmark WHERE month(date) % 3 <> 0)
""")
def intersect_dates(spark, folder):
    """The dates that each ticker has in common with the index."""
    market = Market(spark, folder)
    index = market.staged_benchmark.filter(F.month("date") % 3 != 0).select("date")
    return market.staged_bars.select("ticker", "date").distinct().join(index, "date", "left_semi").select("ticker", "date")


@query("overlap_start", """
SELECT ticker, max(CASE WHEN rn = least(2, n) THEN date END) AS overlap_start
FROM (SELECT t.ticker, s.date, row_number() OVER (PARTITION BY t.ticker ORDER BY s.date DESC) AS rn,
             count(*) OVER (PARTITION BY t.ticker) AS n
      FROM (SELECT ticker, max(date) AS last_date FROM fx_bars GROUP BY ticker) t
      JOIN fx_sessions s ON s.date <= t.last_date) GROUP BY ticker
""")
def overlap_start(spark, folder):
    """The session two market sessions back (inclusive) from each ticker's last bar."""
    market = Market(spark, folder)
    ordinals = w.session_ordinals(market.staged_bars)
    last = market.staged_bars.groupBy("ticker").agg(F.max("date").alias("date")).join(ordinals, "date")
    start = last.select("ticker", F.greatest(F.col("session") - 1, F.lit(1)).alias("session"))
    return start.join(ordinals.withColumnRenamed("date", "overlap_start"), "session").select("ticker", "overlap_start")
