"""Model-portfolio state transition over two end-of-day runs."""

from pyspark.sql import functions as F

from tapeframe.operators import portfolio as pf
from tapeframe.params import ON_FIXTURES
from tapeframe.plans.registry import query, rounded, view
from tapeframe.plans.signals import NEXT_DATE, RUN_DATE, signals
from tapeframe.runtime import stage
from tapeframe.sources import landed as L
from tapeframe.sources.driver import Market

LAST = "2001-07-12"
NUM = "CAST(substr(ticker, 2) AS BIGINT)"
SLOTS = ON_FIXTURES.with_(max_positions=30)

# The state left by the run of LAST: holdings of many ages, orders of both sides, cooldowns.
view("st_positions", f"""
SELECT ticker, DATE '2001-06-01' AS entry_signal_date, DATE '2001-06-02' AS entry_date, {NUM} % 13 AS holding_sessions
FROM fx_companies WHERE {NUM} % 4 = 0
""")
view("st_pending", f"""
SELECT ticker, CASE WHEN {NUM} % 4 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN {NUM} % 9 = 0 THEN DATE '{RUN_DATE}' ELSE DATE '{LAST}' END AS signal_date
FROM fx_companies WHERE {NUM} % 3 = 0
""")
view("st_cooldowns", f"SELECT ticker, {NUM} % 8 AS remaining_sessions FROM fx_companies WHERE {NUM} % 4 <> 0 AND {NUM} % 5 = 1 AND {NUM} % 8 > 0")
view("st_steps", f"SELECT count(*) AS steps FROM fx_sessions WHERE date > DATE '{LAST}' AND date <= DATE '{RUN_DATE}'")
view("st_next", f"""
SELECT ticker, CASE WHEN sell THEN NULL WHEN buy THEN signal_date WHEN held THEN entry_signal_date END AS entry_signal_date,
       CASE WHEN sell THEN NULL WHEN buy THEN DATE '{RUN_DATE}' WHEN held THEN entry_date END AS entry_date,
       CASE WHEN sell THEN NULL WHEN buy THEN greatest(steps - 1, 0) WHEN held THEN holding_sessions + steps END AS holding_sessions,
       CASE WHEN NOT due OR waits THEN side END AS side, CASE WHEN NOT due OR waits THEN signal_date END AS order_date,
       CASE WHEN sell AND 5 - greatest(steps - 1, 0) > 0 THEN 5 - greatest(steps - 1, 0) WHEN cooled > 0 THEN cooled END AS cooldown
FROM (SELECT *, due AND side = 'SELL' AND t AS sell, due AND side = 'SELL' AND NOT t AS waits, due AND side = 'BUY' AND t AND NOT held AND cooled = 0 AS buy
      FROM (SELECT a.ticker, p.entry_signal_date, p.entry_date, p.holding_sessions, p.ticker IS NOT NULL AS held, coalesce(o.side, '') AS side, o.signal_date,
                   coalesce(o.signal_date < DATE '{RUN_DATE}', false) AS due, greatest(coalesce(k.remaining_sessions, 0) - steps, 0) AS cooled, steps,
                   coalesce(g.price_fresh AND g.price > 0 AND g.volume > 0, false) AS t
            FROM (SELECT ticker FROM st_positions UNION SELECT ticker FROM st_pending UNION SELECT ticker FROM st_cooldowns) a
            LEFT JOIN st_positions p ON p.ticker = a.ticker LEFT JOIN st_pending o ON o.ticker = a.ticker LEFT JOIN st_cooldowns k ON k.ticker = a.ticker
            LEFT JOIN fx_signals g ON g.ticker = a.ticker CROSS JOIN st_steps))
""")
view("st_after", "SELECT * REPLACE (nullif(side, '') AS side) FROM st_next WHERE entry_date IS NOT NULL OR nullif(side, '') IS NOT NULL OR cooldown IS NOT NULL")
_CODE = ("concat_ws('|', CASE WHEN exit_ma_trigger THEN 'PRICE_BELOW_MA' END, CASE WHEN exit_trailing_trigger THEN 'TRAILING_STOP_60D' END, "
         "CASE WHEN exit_score_trigger THEN 'SCORE_BELOW_EXIT' END, CASE WHEN exit_market_trigger THEN 'MARKET_REGIME' END)")
view("st_actions", f"""
SELECT *, CASE WHEN held THEN CASE WHEN NOT has_exit_data OR NOT price_fresh THEN 'DATA_REVIEW' WHEN exit_risk_trigger OR (exit_score_trigger AND holding >= 10) THEN 'EXIT' ELSE 'HOLD' END
            WHEN picked THEN 'BUY' WHEN NOT ta_ready THEN 'DATA_REVIEW' ELSE 'WATCH' END AS action,
       CASE WHEN cool > 0 AND entry_eligible THEN 'COOLDOWN' WHEN eligible AND NOT picked THEN 'NO_FREE_SLOT' ELSE watch_reason END AS reason,
       held AND exit_score_trigger AND holding < 10 AND NOT exit_risk_trigger AS blocked, coalesce(nullif({_CODE}, ''), 'NONE') AS code
FROM (SELECT *, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY round(unified_score, 6) DESC, round(selection_strength, 6) DESC, ticker)
               <= greatest(30 - (SELECT count(*) FROM st_after WHERE entry_date IS NOT NULL), 0) AS picked
      FROM (SELECT s.*, a.entry_date IS NOT NULL AS held, coalesce(a.holding_sessions, 0) AS holding, coalesce(a.cooldown, 0) AS cool, a.entry_date AS model_entry_date,
                   s.final_action = 'BUY' AND a.entry_date IS NULL AND coalesce(a.cooldown, 0) = 0 AS eligible
            FROM fx_signals s LEFT JOIN st_after a ON a.ticker = s.ticker))
""")


def first_state(market: Market):
    num = F.expr(L.NUMBER)
    rows = market.companies.select("ticker")
    day = lambda text: F.lit(text).cast("date")
    positions = rows.filter(num % 4 == 0).select(
        "ticker", day("2001-06-01").alias("entry_signal_date"), day("2001-06-02").alias("entry_date"), (num % 13).alias("holding_sessions"))
    pending = rows.filter(num % 3 == 0).select(
        "ticker", F.when(num % 4 == 0, "SELL").otherwise("BUY").alias("side"),
        F.when(num % 9 == 0, day(RUN_DATE)).otherwise(day(LAST)).alias("signal_date"))
    cooldowns = rows.filter((num % 4 != 0) & (num % 5 == 1) & (num % 8 > 0)).select("ticker", (num % 8).alias("remaining_sessions"))
    return positions, pending, cooldowns


def step(market: Market):
    """Signals of the run date and the state after that day's fills."""
    today = stage(signals(market), "signals")
    steps = pf.session_steps(market.staged_benchmark, LAST, RUN_DATE)
    state = pf.advance(*first_state(market), pf.tradable(today), steps, RUN_DATE, SLOTS.cooldown_days)
    return today, stage(state, "state")


def assigned_of(market: Market):
    today, state = step(market)
    return pf.assign_actions(today, state, SLOTS), state


@query("advance_state", "SELECT ticker, entry_signal_date, entry_date, holding_sessions, side, order_date, cooldown FROM st_after")
def advance_state(spark, folder):
    _, state = step(Market(spark, folder))
    return state.select("ticker", "position.entry_signal_date", "position.entry_date", "position.holding_sessions",
                        "order.side", F.col("order.signal_date").alias("order_date"), "cooldown")


@query("advance_state_same_day", "SELECT ticker, entry_date, holding_sessions FROM st_positions")
def advance_state_same_day(spark, folder):
    """A rerun of the same day ages nothing and fills nothing."""
    market = Market(spark, folder)
    everyone = market.companies.select("ticker")
    steps = pf.session_steps(market.benchmark, LAST, LAST)
    state = pf.advance(*first_state(market), everyone, steps, LAST, SLOTS.cooldown_days)
    return state.filter("position IS NOT NULL").select("ticker", "position.entry_date", "position.holding_sessions")


@query("assign_actions", """
SELECT ticker, final_action AS screen_action, action AS final_action, reason AS watch_reason, held AS is_held, holding AS holding_sessions,
       cool AS cooldown_remaining, blocked AS exit_score_blocked_by_min_hold FROM st_actions
""")
def assign_actions(spark, folder):
    out, _ = assigned_of(Market(spark, folder))
    return out.select("ticker", "screen_action", "final_action", "watch_reason", "is_held", "holding_sessions",
                      "cooldown_remaining", "exit_score_blocked_by_min_hold")


@query("exit_reason_code", "SELECT ticker, code AS exit_reason_code, action = 'EXIT' AS exit_triggered FROM st_actions")
def exit_reason_code(spark, folder):
    out, _ = assigned_of(Market(spark, folder))
    return out.select("ticker", "exit_reason_code", "exit_triggered")


view("st_orders", f"""
SELECT ticker, CASE action WHEN 'BUY' THEN 'BUY' ELSE 'SELL' END AS side, DATE '{RUN_DATE}' AS signal_date FROM st_actions WHERE action IN ('BUY', 'EXIT')
UNION ALL SELECT ticker, side, order_date FROM st_after WHERE side IS NOT NULL AND order_date <> DATE '{RUN_DATE}'
  AND ticker NOT IN (SELECT ticker FROM st_actions WHERE action IN ('BUY', 'EXIT'))
""")
view("st_events", f"""
SELECT DATE '{RUN_DATE}' AS signal_date, ticker, action, code AS reason_code, unified_score, holding AS holding_sessions
FROM st_actions WHERE action IN ('BUY', 'EXIT') OR held
""")


@query("new_pending_events", """
SELECT 'order' AS kind, ticker, side AS what, signal_date, CAST(NULL AS VARCHAR) AS reason_code FROM st_orders
UNION ALL SELECT 'event', ticker, action, signal_date, reason_code FROM st_events
""")
def new_pending_events(spark, folder):
    out, state = assigned_of(Market(spark, folder))
    orders = pf.new_orders(out, state, RUN_DATE).select(
        F.lit("order").alias("kind"), "ticker", F.col("side").alias("what"), "signal_date", F.lit(None).cast("string").alias("reason_code"))
    events = pf.new_events(out, RUN_DATE).select(
        F.lit("event").alias("kind"), "ticker", F.col("action").alias("what"), "signal_date", "reason_code")
    return orders.unionByName(events)


@query("write_state_history", f"""
SELECT 'events' AS tbl, signal_date, count(*) AS rows FROM (SELECT signal_date FROM st_events UNION ALL SELECT DATE '{LAST}' FROM fx_companies) GROUP BY signal_date
UNION ALL SELECT 'runs', DATE '{LAST}', 1 UNION ALL SELECT 'runs', DATE '{RUN_DATE}', 1
""")
def write_state_history(spark, folder):
    """Event and run history after writing the run twice: the second write replaces the first."""
    market = Market(spark, folder)
    out, state = assigned_of(market)
    events, run = pf.new_events(out, RUN_DATE), pf.run_row(out, state, RUN_DATE)
    past = market.companies.select(F.lit(LAST).cast("date").alias("signal_date"), "ticker", F.lit("HOLD").alias("action"),
                                   F.lit("NONE").alias("reason_code"), F.lit(50.0).alias("unified_score"), F.lit(1).cast("long").alias("holding_sessions"))
    runs = past.groupBy("signal_date").agg(F.count("*").alias("position_count"), F.lit(0).cast("long").alias("buy_count"), F.lit(0).cast("long").alias("exit_count"))
    once_e, once_r = pf.replace_date(past, events, RUN_DATE), pf.replace_date(runs, run, RUN_DATE)
    twice_e, twice_r = pf.replace_date(stage(once_e, "events"), events, RUN_DATE), pf.replace_date(stage(once_r, "runs"), run, RUN_DATE)
    count = lambda rows, name: rows.groupBy("signal_date").agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "signal_date", "rows")
    return count(twice_e, "events").unionByName(count(twice_r, "runs"))


@query("join_state_signals", """
SELECT p.ticker, p.entry_date, s.action AS final_action, round(s.unified_score + 1e-9, 6) AS unified_score, s.code AS exit_reason_code
FROM st_after p LEFT JOIN st_actions s ON s.ticker = p.ticker WHERE p.entry_date IS NOT NULL
""")
def join_state_signals(spark, folder):
    out, state = assigned_of(Market(spark, folder))
    held = state.filter("position IS NOT NULL").select("ticker", "position.entry_date")
    return held.join(out, "ticker", "left").select("ticker", "entry_date", "final_action", *rounded(["unified_score"], 6), "exit_reason_code")


@query("exists_checks", """
SELECT ticker, action, NOT held AND action = 'EXIT' AS exit_without_position, held AND action = 'BUY' AS buy_already_held FROM st_actions WHERE action IN ('EXIT', 'BUY')
""")
def exists_checks(spark, folder):
    """Exits without a position and buys of what is already held, by anti and semi join."""
    out, state = assigned_of(Market(spark, folder))
    rows = stage(out.filter(F.col("final_action").isin("EXIT", "BUY")).select("ticker", "final_action"), "acted")
    held = state.filter("position IS NOT NULL").select("ticker")
    stray = rows.filter("final_action = 'EXIT'").join(held, "ticker", "left_anti").select("ticker", F.lit(True).alias("stray"))
    again = rows.filter("final_action = 'BUY'").join(held, "ticker", "left_semi").select("ticker", F.lit(True).alias("again"))
    return rows.join(stray, "ticker", "left").join(again, "ticker", "left").select(
        "ticker", F.col("final_action").alias("action"), F.coalesce("stray", F.lit(False)).alias("exit_without_position"),
        F.coalesce("again", F.lit(False)).alias("buy_already_held"))


@query("screen_next_day", f"SELECT ticker, signal_date, final_action, watch_reason FROM fx2_signals")
def screen_next_day(spark, folder):
    """The screen of the following run, from data up to that day only."""
    return signals(Market(spark, folder), NEXT_DATE).select("ticker", "signal_date", "final_action", "watch_reason")
