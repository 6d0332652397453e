"""End-of-day state transition of the model portfolio.

State is three keyed tables (positions, pending orders, cooldowns).  A step joins
them on the ticker and is otherwise a projection, so it scales with the universe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.functions.numeric import is_true
from tapeframe.params import Strategy



def session_steps(calendar: DataFrame, last_date: str | None, current_date: str) -> Column:
    """Market sessions in (last, current]; zero on a rerun of the same day."""
    if last_date is None or current_date <= last_date:
        return F.lit(0)
    inside = (F.col("date") > F.lit(last_date).cast("date")) & (F.col("date") <= F.lit(current_date).cast("date"))
    return calendar.agg(F.count_distinct(F.when(inside, F.col("date")))).scalar()


def advance(positions: DataFrame, pending: DataFrame, cooldowns: DataFrame, tradable: DataFrame,
            steps: Column, current_date: str, cooldown_days: int) -> DataFrame:
    """Age holdings, run down cooldowns and fill the orders of earlier days.

    Returns one row per ticker of the old state with the new position, order and
    cooldown (null where there is none).  A sell waits for a tradable session; a buy
    that cannot be filled is dropped.
    """
    c = F.col
    p = positions.select("ticker", F.struct("entry_signal_date", "entry_date", "holding_sessions").alias("p"))
    o = pending.select("ticker", F.struct("side", "signal_date").alias("o"))
    k = cooldowns.select("ticker", c("remaining_sessions").alias("k"))
    t = tradable.select("ticker", F.lit(True).alias("t")).distinct()
    s = p.join(o, "ticker", "full").join(k, "ticker", "full").join(t, "ticker", "left")
    s = s.withColumns({"steps": steps.cast("long"), "t": F.coalesce("t", F.lit(False))})
    moved = c("steps") > 0
    today = F.lit(current_date).cast("date")
    cooled = F.greatest(F.coalesce(c("k"), F.lit(0)) - c("steps"), F.lit(0))
    due = is_true(moved & (c("o.signal_date") < today))
    sell = due & (c("o.side") == "SELL") & c("t")
    waits = due & (c("o.side") == "SELL") & ~c("t")
    buy = due & (c("o.side") == "BUY") & c("t") & c("p").isNull() & (cooled == 0)
    aged = F.struct(c("p.entry_signal_date"), c("p.entry_date"), (c("p.holding_sessions") + c("steps")).alias("holding_sessions"))
    opened = F.struct(c("o.signal_date").alias("entry_signal_date"), today.alias("entry_date"),
                      F.greatest(c("steps") - 1, F.lit(0)).cast("long").alias("holding_sessions"))
    rest = F.greatest(F.lit(cooldown_days) - F.greatest(c("steps") - 1, F.lit(0)), F.lit(0))
    new_p = F.when(~moved, c("p")).when(is_true(sell), F.lit(None)).when(is_true(buy), opened).when(c("p").isNotNull(), aged)
    new_o = F.when(~due | is_true(waits), c("o"))
    new_k = F.when(~moved, c("k")).when(is_true(sell) & (rest > 0), rest).when(cooled > 0, cooled)
    out = s.select("ticker", new_p.alias("position"), new_o.alias("order"), new_k.cast("long").alias("cooldown"))
    return out.filter("position IS NOT NULL OR order IS NOT NULL OR cooldown IS NOT NULL")


def tradable(signals: DataFrame) -> DataFrame:
    return signals.filter(is_true(F.col("price_fresh") & (F.col("price") > 0) & (F.col("volume") > 0))).select("ticker")


def assign_actions(signals: DataFrame, state: DataFrame, strategy: Strategy) -> DataFrame:
    """The action of each ticker given the state after today's fills.

    A position marked for exit today keeps its slot until the next session.
    """
    c = F.col
    s = state.select("ticker", "position", "cooldown")
    out = signals.join(s, "ticker", "left").withColumns({
        "screen_action": c("final_action"), "is_held": c("position").isNotNull(),
        "model_entry_date": c("position.entry_date"),
        "holding_sessions": F.coalesce(c("position.holding_sessions"), F.lit(0)).cast("long"),
        "cooldown_remaining": F.coalesce(c("cooldown"), F.lit(0)).cast("long")}).drop("position", "cooldown")
    score_exit = c("exit_score_trigger") & (c("holding_sessions") >= strategy.minimum_holding_days)
    held = (F.when(~c("has_exit_data") | ~c("price_fresh"), "DATA_REVIEW")
            .when(c("exit_risk_trigger") | score_exit, "EXIT").otherwise("HOLD"))
    eligible = (c("screen_action") == "BUY") & ~c("is_held") & (c("cooldown_remaining") == 0)
    occupied = state.filter("position IS NOT NULL").agg(F.count("*")).scalar()
    # Screened buys number at most the slots of the screen, so this ranking is over few rows.
    order = [F.round("unified_score", 6).desc(), F.round("selection_strength", 6).desc(), c("ticker").asc()]
    best = out.filter(eligible).orderBy(*order).limit(strategy.max_positions)
    slots = F.greatest(F.lit(strategy.max_positions) - occupied, F.lit(0))
    from pyspark.sql import Window
    picked = best.withColumn("_slot", F.row_number().over(Window.orderBy(*order))).filter(c("_slot") <= slots).select(
        "ticker", F.lit(True).alias("_picked"))
    out = out.join(picked, "ticker", "left")
    chosen = F.coalesce(c("_picked"), F.lit(False))
    action = F.when(c("is_held"), held).when(chosen, "BUY").when(~c("ta_ready"), "DATA_REVIEW").otherwise("WATCH")
    reason = (F.when((c("cooldown_remaining") > 0) & c("entry_eligible"), "COOLDOWN")
              .when(eligible & ~chosen, "NO_FREE_SLOT").otherwise(c("watch_reason")))
    out = out.withColumns({
        "final_action": action, "watch_reason": reason,
        "exit_score_blocked_by_min_hold": c("is_held") & c("exit_score_trigger")
        & (c("holding_sessions") < strategy.minimum_holding_days) & ~c("exit_risk_trigger"),
        "exit_reason_code": exit_reason_code()}).drop("_picked")
    return out.withColumn("exit_triggered", c("final_action") == "EXIT")


def exit_reason_code() -> Column:
    codes = (("exit_ma_trigger", "PRICE_BELOW_MA"), ("exit_trailing_trigger", "TRAILING_STOP_60D"),
             ("exit_score_trigger", "SCORE_BELOW_EXIT"), ("exit_market_trigger", "MARKET_REGIME"))
    joined = F.concat_ws("|", *[F.when(F.col(n), code) for n, code in codes])
    return F.when(joined == "", "NONE").otherwise(joined)


def new_orders(assigned: DataFrame, state: DataFrame, current_date: str) -> DataFrame:
    """Open orders after today: older ones still waiting, then today's buys and sells."""
    today = F.lit(current_date).cast("date")
    made = assigned.filter(F.col("final_action").isin("BUY", "EXIT")).select(
        "ticker", F.when(F.col("final_action") == "BUY", "BUY").otherwise("SELL").alias("side"), today.alias("signal_date"))
    kept = state.filter(F.col("order").isNotNull() & (F.col("order.signal_date") != today)).select("ticker", "order.*")
    return kept.join(made.select("ticker"), "ticker", "left_anti").unionByName(made)


def new_events(assigned: DataFrame, current_date: str) -> DataFrame:
    wanted = F.col("final_action").isin("BUY", "EXIT") | F.col("is_held")
    return assigned.filter(wanted).select(
        F.lit(current_date).cast("date").alias("signal_date"), "ticker", F.col("final_action").alias("action"),
        F.col("exit_reason_code").alias("reason_code"), "unified_score", "holding_sessions")


def replace_date(history: DataFrame, today: DataFrame, current_date: str) -> DataFrame:
    """Append a run's rows, replacing those an earlier run of the same date left."""
    return history.filter(F.col("signal_date") != F.lit(current_date).cast("date")).unionByName(today)


def run_row(assigned: DataFrame, state: DataFrame, current_date: str) -> DataFrame:
    count = lambda a: F.count(F.when(F.col("final_action") == a, 1))
    held = state.filter("position IS NOT NULL").agg(F.count("*")).scalar()
    return assigned.agg(count("BUY").alias("buy_count"), count("EXIT").alias("exit_count")).select(
        F.lit(current_date).cast("date").alias("signal_date"), held.alias("position_count"), "buy_count", "exit_count")
