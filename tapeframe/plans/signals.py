"""Price/volume feature and signal queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators import fundamentals as fa_ops
from tapeframe.operators import signals as sg
from tapeframe.params import ON_FIXTURES
from tapeframe.plans.fundamentals import signal_fa
from tapeframe.plans.registry import query, rounded, sql_round, view
from tapeframe.plans.windows import W, sql_rolling
from tapeframe.sources.driver import Market

LIQUID = 50000.0
# Two consecutive end-of-day runs on which the tables have both buys and leftovers.
RUN_DATE, NEXT_DATE, TOP = "2001-07-16", "2001-07-17", 3

view("fx_ta", f"""
SELECT b.ticker, b.date, b.close AS px, b.volume, r.r3, r.r6, r.r12, r.bm_r6, r.r6 - r.bm_r6 AS rs6,
       m.bm_px, m.bm_ma50, m.bm_ma100, m.bm_ma200, b.volume / nullif(b.avg_volume, 0) AS volume_ratio, b.avg_volume,
       b.ma20, b.ma50, b.ma100, b.ma200, b.high_close20, b.high_close60, b.volatility20, b.avg_trading_value20
FROM (SELECT ticker, date, close, volume, {', '.join(f"{sql_rolling('avg', 'close', n)} AS ma{n}" for n in (20, 50, 100, 200))},
        {sql_rolling('max', 'close', 20, 1)} AS high_close20, {sql_rolling('max', 'close', 60, 1)} AS high_close60,
        {sql_rolling('stddev_pop', 'x', 20)} AS volatility20, {sql_rolling('avg', 'volume', 20, 1)} AS avg_volume,
        {sql_rolling('avg', 'trading_value', 20, 1)} AS avg_trading_value20
      FROM (SELECT *, close / lag(close) {W}) - 1 AS x FROM fx_bars)) b
JOIN fx_returns r ON r.ticker = b.ticker AND r.date = b.date JOIN fx_bm m ON m.date = b.date
""")
HISTORY = {"r3": 8, "r6": 8, "r12": 8, "rs6": 8, "bm_px": 6, "bm_ma50": 6, "bm_ma100": 6, "bm_ma200": 6, "ma20": 4,
           "ma50": 4, "ma100": 4, "ma200": 4, "high_close20": 8, "high_close60": 8, "volatility20": 8,
           "volume_ratio": 6, "avg_trading_value20": 4}


@query("ta_history", f"""
SELECT ticker, date, px, volume, {', '.join(f'round({c}, {d}) AS {c}' for c, d in HISTORY.items())} FROM fx_ta
""")
def ta_history(spark, folder):
    return history(Market(spark, folder)).select(
        "ticker", "date", "px", "volume", *[F.round(c, d).alias(c) for c, d in HISTORY.items()])


def history(market: Market) -> DataFrame:
    return sg.ta_history(market.staged_bars, market.staged_benchmark)


def _register_signal_views(p: str, run_date: str) -> None:
    """The signal chain as of one run date; ``p`` prefixes the view names."""
    view(f"{p}_ta_latest", f"""
SELECT *, concat_ws(', ', CASE WHEN r_3m IS NULL THEN 'r_3m' END, CASE WHEN r_6m IS NULL THEN 'r_6m' END,
         CASE WHEN r_12m IS NULL THEN 'r_12m' END, CASE WHEN rs_6m IS NULL THEN 'rs_6m' END,
         CASE WHEN ma50 IS NULL THEN 'ma50' END, CASE WHEN ma200 IS NULL THEN 'ma200' END,
         CASE WHEN volume_ratio IS NULL THEN 'volume_ratio' END,
         CASE WHEN high_close20 IS NULL THEN 'high_close20' END) AS missing_data_reason,
       coalesce(r_3m > 0 AND r_6m > 0 AND r_12m > 0, false) AS momentum_pass, coalesce(rs_6m > 0, false) AS rs_pass,
       coalesce(price > ma50 AND ma50 > ma200, false) AS trend_pass, coalesce(price > high_close20, false) AS breakout_pass,
       coalesce(volume_ratio >= 0.8, false) AS volume_pass
FROM (SELECT ticker, date AS signal_date, px AS price, sessions, volume, r3 AS r_3m, r6 AS r_6m, r12 AS r_12m, rs6 AS rs_6m,
        ma20, ma50, ma100, ma200, high_close20, high_close60, avg_volume AS avg_vol20, volume_ratio,
        avg_trading_value20 AS avg_trading_value_20d, date = (SELECT max(date) FROM fx_bm WHERE date <= DATE '{run_date}') AS price_fresh,
        (SELECT coalesce(bm_px >= bm_ma50, false) FROM fx_bm WHERE date <= DATE '{run_date}' ORDER BY date DESC LIMIT 1) AS market_bull
      FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS sessions,
                   row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fx_ta WHERE date <= DATE '{run_date}') WHERE rn = 1)
""")
    view(f"{p}_ta_scored", f"""
SELECT *, CASE WHEN missing_data_reason = '' THEN 'READY' ELSE 'DATA_REVIEW' END AS ta_status,
       30.0 * momentum_pass::INT + 25.0 * rs_pass::INT + 25.0 * trend_pass::INT + 15.0 * breakout_pass::INT
       + 5.0 * volume_pass::INT AS ta_score,
       CAST(momentum_pass::INT + rs_pass::INT + trend_pass::INT + breakout_pass::INT + volume_pass::INT AS BIGINT) AS conditions_met
FROM {p}_ta_latest
""")
    view(f"{p}_scored", f"""
SELECT *, 0.2 * effective_fa + 0.8 * coalesce(ta_score, 0) AS unified_score,
       0.15 * coalesce(r_3m, -10) + 0.30 * coalesce(r_6m, -10) + 0.35 * coalesce(r_12m, -10) + 0.20 * coalesce(rs_6m, -10)
         AS selection_strength,
       coalesce(avg_trading_value_20d >= {LIQUID}, false) AS liquid, coalesce(ta_status = 'READY', false) AS ta_ready
FROM (SELECT f.ticker, f.company_name, f.exchange, f.sector, f.industry, f.fa_score, f.fa_coverage, f.fa_status, f.fa_pass,
        f.quality_score, f.growth_score, f.value_score, f.safety_score,
        f.hard_reject_reason, f.hard_reject_reason <> '' AS rejected,
        CASE WHEN f.hard_reject_reason <> '' THEN 0.0
             ELSE 50 + (coalesce(f.fa_score, 50) - 50) * least(greatest(coalesce(f.fa_coverage, 0), 0), 1) END AS effective_fa,
        coalesce(t.market_bull, false) AS market_bull, coalesce(t.price_fresh, false) AS price_fresh,
        t.* EXCLUDE (ticker, market_bull, price_fresh)
      FROM fx_fa_basis f LEFT JOIN {p}_ta_scored t ON t.ticker = f.ticker)
""")
    view(f"{p}_gated", f"""
SELECT *, exit_ma_trigger OR exit_trailing_trigger OR exit_market_trigger AS exit_risk_trigger,
       CASE WHEN entry_eligible THEN row_number() OVER (ORDER BY entry_eligible DESC, round(unified_score, 6) DESC NULLS LAST,
            round(selection_strength, 6) DESC NULLS LAST, ticker) END AS unified_rank
FROM (SELECT *, coalesce(unified_score >= 60 AND NOT rejected AND ta_ready AND liquid AND market_bull AND price_fresh, false)
               AS entry_eligible,
             price IS NOT NULL AND ma200 IS NOT NULL AS has_exit_data,
             coalesce(ma200 IS NOT NULL AND price < ma200, false) AS exit_ma_trigger,
             coalesce(unified_score < 35, false) AS exit_score_trigger,
             coalesce(price < high_close60 * 0.85, false) AS exit_trailing_trigger, false AS exit_market_trigger
      FROM {p}_scored)
""")
    view(f"{p}_signals", f"""
SELECT *, concat('FA=', coalesce(CAST(round(fa_score, 1) AS VARCHAR), 'NA'), '; coverage=',
         coalesce(CAST(round(fa_coverage * 100, 0) AS VARCHAR), '0'), '%; price_volume=',
         coalesce(CAST(CAST(round(ta_score, 1) AS DOUBLE) AS VARCHAR), '0'), '; unified=',
         coalesce(CAST(round(unified_score, 1) AS VARCHAR), 'NA'), '; entry=60.0; exit=35.0; top={TOP}; liquid=',
         CASE WHEN liquid THEN 'True' ELSE 'False' END, '; market_bull=', CASE WHEN market_bull THEN 'True' ELSE 'False' END,
         '; price_fresh=', CASE WHEN price_fresh THEN 'True' ELSE 'False' END, '; reason=', watch_reason,
         CASE WHEN rejected THEN concat('; reject=', hard_reject_reason) ELSE '' END,
         CASE WHEN coalesce(missing_data_reason, '') <> '' THEN concat('; missing=', missing_data_reason) ELSE '' END)
         AS decision_reason,
       CASE WHEN market_bull THEN 'BULL_ABOVE_REGIME_MA' ELSE 'DEFENSIVE_BELOW_REGIME_MA' END AS market_context
FROM (SELECT *, CASE WHEN NOT ta_ready THEN 'DATA_REVIEW' WHEN entry_eligible AND unified_rank <= {TOP} THEN 'BUY' ELSE 'WATCH' END
               AS final_action,
             CASE WHEN NOT ta_ready THEN 'MISSING_TA' WHEN NOT price_fresh THEN 'STALE_PRICE' WHEN rejected THEN 'FA_HARD_REJECT'
                  WHEN NOT market_bull THEN 'MARKET_DEFENSIVE' WHEN NOT liquid THEN 'ILLIQUID'
                  WHEN unified_score < 60 THEN 'SCORE_BELOW_ENTRY' WHEN entry_eligible AND unified_rank > {TOP} THEN 'OUTSIDE_TOP_N'
                  ELSE 'NONE' END AS watch_reason FROM {p}_gated)
""")




_register_signal_views("fx", RUN_DATE)
_register_signal_views("fx2", NEXT_DATE)
SNAPSHOT = {"r_3m": 8, "r_6m": 8, "r_12m": 8, "rs_6m": 8, "ma20": 4, "ma50": 4, "ma100": 4, "ma200": 4,
            "high_close20": 8, "high_close60": 8, "avg_vol20": 6, "volume_ratio": 6, "avg_trading_value_20d": 4}


def latest(market: Market, run_date: str = RUN_DATE) -> DataFrame:
    known = F.col("date") <= F.lit(run_date).cast("date")
    return sg.ta_latest(market.staged_bars.filter(known), market.staged_benchmark.filter(known), ON_FIXTURES)


@query("ta_snapshot", f"""
SELECT ticker, signal_date, price, sessions, volume, market_bull, price_fresh, missing_data_reason,
       {', '.join(f'round({c}, {d}) AS {c}' for c, d in SNAPSHOT.items())} FROM fx_ta_latest
""")
def ta_snapshot(spark, folder):
    return latest(Market(spark, folder)).select(
        "ticker", "signal_date", "price", "sessions", "volume", "market_bull", "price_fresh", "missing_data_reason",
        *[F.round(c, d).alias(c) for c, d in SNAPSHOT.items()])


@query("ta_flags_score", """
SELECT ticker, momentum_pass, rs_pass, trend_pass, breakout_pass, volume_pass, conditions_met,
       conditions_met >= 5 AND missing_data_reason = '' AS buy_pass, CAST(ta_score AS DOUBLE) AS ta_score, ta_status FROM fx_ta_scored
""")
def ta_flags_score(spark, folder):
    return latest(Market(spark, folder)).select(
        "ticker", *sg.FLAGS.values(), "conditions_met", "buy_pass", "ta_score", "ta_status")


def signals(market: Market, run_date: str = RUN_DATE) -> DataFrame:
    return sg.build_signals(signal_fa(market), latest(market, run_date), ON_FIXTURES)


@query("join_fa_ta", """
SELECT f.ticker, round(f.fa_score + 1e-9, 6) AS fa_score, CAST(t.ta_score AS DOUBLE) AS ta_score, t.ta_status, t.signal_date
FROM fx_fa_basis f LEFT JOIN fx_ta_scored t ON t.ticker = f.ticker
""")
def join_fa_ta(spark, folder):
    market = Market(spark, folder)
    return signal_fa(market).join(latest(market), "ticker", "left").select(
        "ticker", *rounded(["fa_score"], 6), "ta_score", "ta_status", "signal_date")


@query("unified_score", """
SELECT ticker, round(effective_fa + 1e-9, 6) AS effective_fa, round(unified_score + 1e-9, 6) AS unified_score FROM fx_scored
""")
def unified_score(spark, folder):
    market = Market(spark, folder)
    out = sg.with_unified_score(signal_fa(market).join(latest(market), "ticker", "left"), ON_FIXTURES)
    return out.select("ticker", *rounded(["effective_fa", "unified_score"], 6))


@query("unified_score_history", """
SELECT t.ticker, t.date, round(1e-9 + 0.2 * a.effective_fa + 0.8 * (
         30 * coalesce(r3 > 0 AND r6 > 0 AND r12 > 0, false)::INT + 25 * coalesce(rs6 > 0, false)::INT
         + 25 * coalesce(px > ma50 AND ma50 > ma200, false)::INT + 15 * coalesce(px > high_close20, false)::INT
         + 5 * coalesce(volume_ratio >= 0.8, false)::INT), 6) AS score
FROM fx_ta t JOIN fx_asof_fa a ON a.ticker = t.ticker AND a.date = t.date
""")
def unified_score_history(spark, folder):
    market = Market(spark, folder)
    return scored_history(market).select("ticker", "date", *rounded(["score"], 6))


def scored_history(market: Market, lag_days: int | None = None) -> DataFrame:
    """Feature history with the point-in-time fundamental score and the unified score."""
    from tapeframe.operators.research import with_history_score
    panel = fa_ops.fa_panel(market.companies, market.fin_wide, ON_FIXTURES, lag_days)
    return with_history_score(fa_ops.asof_fa(panel, history(market)), ON_FIXTURES)


@query("selection_strength", "SELECT ticker, round(selection_strength, 6) AS selection_strength FROM fx_scored")
def selection_strength(spark, folder):
    return latest_with_companies(Market(spark, folder)).select(
        "ticker", F.round(sg.selection_strength("r_3m", "r_6m", "r_12m", "rs_6m"), 6).alias("selection_strength"))


def latest_with_companies(market: Market) -> DataFrame:
    return market.companies.join(latest(market), "ticker", "left")


@query("candidate_gates", """
SELECT ticker, ta_ready, liquid, market_bull, price_fresh, rejected, entry_eligible FROM fx_gated
""")
def candidate_gates(spark, folder):
    market = Market(spark, folder)
    out = sg.with_unified_score(signal_fa(market).join(latest(market), "ticker", "left"), ON_FIXTURES)
    return sg.with_gates(out, ON_FIXTURES).select(
        "ticker", "ta_ready", "liquid", "market_bull", "price_fresh", "rejected", "entry_eligible")


TRIGGERS = ["has_exit_data", "exit_ma_trigger", "exit_score_trigger", "exit_trailing_trigger", "exit_market_trigger",
            "exit_risk_trigger"]


@query("exit_triggers", f"SELECT ticker, {', '.join(TRIGGERS)} FROM fx_gated")
def exit_triggers(spark, folder):
    market = Market(spark, folder)
    out = sg.with_unified_score(signal_fa(market).join(latest(market), "ticker", "left"), ON_FIXTURES)
    return sg.with_exit_triggers(sg.with_gates(out, ON_FIXTURES), ON_FIXTURES).select("ticker", *TRIGGERS)


@query("unified_rank", "SELECT ticker, round(unified_score + 1e-9, 6) AS unified_score, unified_rank FROM fx_gated")
def unified_rank(spark, folder):
    return signals(Market(spark, folder)).select("ticker", *rounded(["unified_score"], 6), "unified_rank")


@query("final_action", """
SELECT ticker, final_action, watch_reason, market_context, decision_reason FROM fx_signals
""")
def final_action(spark, folder):
    return signals(Market(spark, folder)).select(
        "ticker", "final_action", "watch_reason", "market_context", "decision_reason")


RANKING = ["unified_score", "selection_strength", "fa_score", "ta_score"]
_ORDER = "round(unified_score, 6) DESC NULLS LAST, round(selection_strength, 6) DESC NULLS LAST, ticker"


@query("action_sorted_signals", f"""
SELECT ticker, final_action, {sql_round(RANKING[:3], 6)}, CAST(ta_score AS DOUBLE) AS ta_score,
       CASE final_action WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 2 WHEN 'WATCH' THEN 3 WHEN 'DATA_REVIEW' THEN 4 ELSE 5 END AS action_order
FROM fx_signals
""")
def action_sorted_signals(spark, folder):
    return signals(Market(spark, folder)).select(
        "ticker", "final_action", *rounded(RANKING[:3], 6), "ta_score", sg.action_rank().alias("action_order")).orderBy(
        "action_order", F.desc_nulls_last("unified_score"), F.desc_nulls_last("fa_score"),
        F.desc_nulls_last("ta_score"), "ticker")


@query("rankings", f"""
SELECT ticker, final_action, {sql_round(RANKING[:3], 6)}
FROM (SELECT *, CASE final_action WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 2 WHEN 'WATCH' THEN 3 WHEN 'DATA_REVIEW' THEN 4 ELSE 5 END AS o
      FROM fx_signals) ORDER BY o, {_ORDER} LIMIT 20
""")
def rankings(spark, folder):
    """Default board: best twenty by action, score and strength."""
    from tapeframe.operators.serving import rankings as top
    return top(signals(Market(spark, folder)), 20).select("ticker", "final_action", *rounded(RANKING[:3], 6))
