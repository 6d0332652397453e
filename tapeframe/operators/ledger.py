"""Per-account trade ledgers.

The average-cost rule is a fold in trade order, yet it splits: with the quantity
before each trade known from a running sum, a trade maps the cost basis to
``a * basis + b``.  Such maps compose, so an account's trades are cut into chunks
of bounded length, each chunk is folded on its own, and the short list of chunk
results is folded last.  One account holding a third of all trades is therefore
spread over many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.operators.windows import session_number_asof
from tapeframe.runtime import stage

CHUNK = 250_000
FEE_RATE = 0.0015


def with_amounts(trades: DataFrame, fee_rate: float = FEE_RATE) -> DataFrame:
    return trades.withColumn("gross", F.col("price") * F.col("quantity")).withColumn(
        "fee", F.round(F.col("gross") * fee_rate + 1e-9, 2))


def _chunked(trades: DataFrame, chunk: int) -> DataFrame:
    """Cut the log into ranges of trade ids, so a (key, range) holds at most ``chunk`` trades."""
    return trades.withColumn("_chunk", F.floor(F.col("id") / chunk))


def positions(trades: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Quantity, cost basis and realised profit per (account, ticker) at average cost after fees.

    ``trades`` carries gross and fee, and sells never exceed what is held.
    """
    keys = ["account", "ticker"]
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    t = _chunked(trades, chunk).withColumn("_signed", signed)
    totals = t.groupBy(*keys, "_chunk").agg(F.sum("_signed").alias("_d"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_q0", F.coalesce(F.sum("_d").over(before), F.lit(0))).drop("_d")
    rows = t.join(starts, [*keys, "_chunk"])
    inside = Window.partitionBy(*keys, "_chunk").orderBy("id")
    held = F.col("_q0") + F.coalesce(F.sum("_signed").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_held", held)
    steps = rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct(
        "id", "side", "quantity", "gross", "fee", "_held"))).alias("_s"))
    # Within a chunk the basis is a * start + b and the profit r + s * start.
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("r"), F.lit(0.0).alias("s"))

    def fold(acc, x):
        sold = F.when(x["_held"] > 0, x["quantity"] / x["_held"]).otherwise(0.0)
        keep = F.when(x["_held"] > 0, (x["_held"] - x["quantity"]) / x["_held"]).otherwise(0.0)
        buy = x["side"] == "BUY"
        return F.struct(
            F.when(buy, acc["a"]).otherwise(acc["a"] * keep).alias("a"),
            F.when(buy, acc["b"] + x["gross"] + x["fee"]).otherwise(acc["b"] * keep).alias("b"),
            F.when(buy, acc["r"]).otherwise(acc["r"] + x["gross"] - x["fee"] - acc["b"] * sold).alias("r"),
            F.when(buy, acc["s"]).otherwise(acc["s"] - acc["a"] * sold).alias("s"))

    maps = steps.withColumn("_m", F.aggregate("_s", start, fold)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_m"))).alias("_c"))
    zero = F.struct(F.lit(0.0).alias("cost_basis"), F.lit(0.0).alias("realized"))
    total = F.aggregate("_c", zero, lambda acc, c: F.struct(
        (c["_m"]["a"] * acc["cost_basis"] + c["_m"]["b"]).alias("cost_basis"),
        (acc["realized"] + c["_m"]["r"] + c["_m"]["s"] * acc["cost_basis"]).alias("realized")))
    quantity = t.groupBy(*keys).agg(F.sum("_signed").alias("quantity"))
    return maps.select(*keys, total.alias("_t")).join(quantity, keys).select(
        *keys, "quantity", F.col("_t.cost_basis").alias("cost_basis"), F.col("_t.realized").alias("realized_pnl"))


def cash(trades: DataFrame, initial_cash: float) -> DataFrame:
    """Cash per account from signed amounts; order does not matter."""
    flow = F.when(F.col("side") == "BUY", -(F.col("gross") + F.col("fee"))).otherwise(F.col("gross") - F.col("fee"))
    return trades.groupBy("account").agg((F.sum(flow) + initial_cash).alias("cash"), F.count("*").alias("trades"))


def entry_dates(trades: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Date on which a currently open position last went from none to some.

    Daily totals are not enough, so the running quantity is taken trade by trade, in
    two steps: slice totals first, then within a slice.
    """
    keys = ["account", "ticker"]
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    t = _chunked(trades, chunk).withColumn("_signed", signed)
    totals = t.groupBy(*keys, "_chunk").agg(F.sum("_signed").alias("_d"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_q0", F.coalesce(F.sum("_d").over(before), F.lit(0))).drop("_d")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.join(starts, [*keys, "_chunk"]).withColumn("_after", F.col("_q0") + F.sum("_signed").over(inside))
    opens = (F.col("_after") > 0) & (F.col("_after") - F.col("_signed") <= 0)
    return rows.groupBy(*keys).agg(
        F.sum("_signed").alias("quantity"),
        F.max_by(F.when(opens, F.col("market_date")), F.when(opens, F.col("id"))).alias("_entry")).select(
        *keys, "quantity", F.when(F.col("quantity") > 0, F.col("_entry")).alias("entry_date"))


ORDER = ["id", "account", "side", "ticker", "quantity", "price", "market_date"]
REPLAYED = ", gross double, fee double, cash_after double, status string"
STATE = "account {0}, slice long, cash double, held map<string,bigint>"
ROUNDS = 2  # of guessed starts
NEAR = 1e-6  # a cash bound nearer than this, relative, is not trusted to rounding


class Walk:
    """The state of one account while its orders pass, and for which other starts the same orders pass the same way.

    As long as the same orders are accepted, cash and holdings differ from another start by a constant.  Every decision
    bounds that constant: an accepted order from below, a rejected one from above.
    """

    def __init__(self, cash: float, held: dict[str, int], fee_rate: float, tolerance: float):
        self.cash, self.held, self.fee_rate, self.tolerance = cash, dict(held), fee_rate, tolerance
        self.cash_low, self.cash_high = -float("inf"), float("inf")
        self.held_low: dict[str, int] = {}
        self.held_high: dict[str, int] = {}

    def pass_order(self, side: str, ticker: str, quantity: int, price: float) -> tuple[float, float, float, str]:
        gross = price * quantity
        fee = round(gross * self.fee_rate + 1e-9, 2)
        if not (isinstance(ticker, str) and ticker.isalnum() and len(ticker) <= 12):
            return gross, fee, self.cash, "BAD_TICKER"
        if not 0 < quantity <= 10_000_000:
            return gross, fee, self.cash, "BAD_QUANTITY"
        if side == "BUY":
            room = self.cash - gross - fee + self.tolerance
            if room < 0:
                self.cash_high = min(self.cash_high, -room)
                return gross, fee, self.cash, "OVERSPEND"
            self.cash_low = max(self.cash_low, -room)
            self.cash -= gross + fee
            self.held[ticker] = self.held.get(ticker, 0) + quantity
        else:
            spare = self.held.get(ticker, 0) - quantity
            if spare < 0:
                self.held_high[ticker] = min(self.held_high.get(ticker, 1 << 62), -spare)
                return gross, fee, self.cash, "OVERSELL"
            self.held_low[ticker] = max(self.held_low.get(ticker, -(1 << 62)), -spare)
            self.cash += gross - fee
            self.held[ticker] = spare
        return gross, fee, self.cash, "ACCEPTED"


def _passed(orders: pd.DataFrame, walk: Walk) -> pd.DataFrame:
    ordered = orders.sort_values("id", kind="stable")
    out = [walk.pass_order(*row) for row in ordered[["side", "ticker", "quantity", "price"]].itertuples(index=False, name=None)]
    return pd.concat([ordered.reset_index(drop=True), pd.DataFrame(out, columns=["gross", "fee", "cash_after", "status"])], axis=1)


def _walk_in_order(orders: DataFrame, initial_cash: float, fee_rate: float, tolerance: float, out: str) -> DataFrame:
    """Accounts one after the other along sorted batches; a task keeps one account's cash and holdings.

    Orders may carry what their account starts with, as ``cash`` and ``held``.
    """
    placed = "cash" in orders.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, state = None, None
        for batch in batches:
            result = []
            starts = zip(batch["cash"], batch["held"]) if placed else itertools.repeat((initial_cash, {}))
            orders_of = batch[["account", "side", "ticker", "quantity", "price"]].itertuples(index=False, name=None)
            for (own, *order), (cash, held) in zip(orders_of, starts):
                if state is None or own != account:
                    account, state = own, Walk(cash, dict(held), fee_rate, tolerance)
                result.append(state.pass_order(*order))
            yield pd.concat([batch[ORDER].reset_index(drop=True),
                             pd.DataFrame(result, columns=["gross", "fee", "cash_after", "status"])], axis=1)

    return orders.repartition("account").sortWithinPartitions("account", "id").mapInPandas(walk, out)


def sliced(orders: DataFrame, chunk: int) -> DataFrame:
    """Adds ``slice``: consecutive stretches of an account's orders of about ``chunk``, at most 1.25 of it.

    Orders are counted in narrow ranges of ids, and the counts are added up along an account, so no account is sorted.
    """
    narrow = F.floor(F.col("id") / max(1, chunk // 4))
    counts = orders.groupBy("account", narrow.alias("_range")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("account").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.select("account", "_range", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / chunk).alias("slice"))
    return orders.withColumn("_range", narrow).join(slices, ["account", "_range"]).drop("_range")


def _replay_slices(orders: DataFrame, initial_cash: float, fee_rate: float, tolerance: float, out: str) -> DataFrame:
    """Orders with ``slice``: all slices of an account at once, each from a guess of what it starts with.

    A round walks the slices whose guess was off.  Then an account's slices, few, are gone through in order: what a
    slice does is known for every start within its bounds, so starts are exact up to the first slice whose bounds do
    not hold, and predicted after it.  That slice has its exact start in the next round, so rounds end; where
    decisions do not hang on a narrow margin they are few.  An account at its cash limit would need a round per slice,
    each over all that is left; so after ``ROUNDS`` of them what is left of an account, from its first slice that is
    not proven, is walked in order from its exact start.  At last the proven slices are walked from theirs.
    """
    kind = orders.schema["account"].dataType.simpleString()
    state = STATE.format(kind)
    result = state + ", cash_by double, cash_low double, cash_high double, held_by map<string,bigint>, held_low map<string,bigint>, held_high map<string,bigint>"

    def summary(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(start):
            return pd.DataFrame(columns=["account", "slice", "cash", "held", "cash_by", "cash_low", "cash_high", "held_by", "held_low", "held_high"])
        cash, held = float(start["cash"].iloc[0]), dict(start["held"].iloc[0])
        walk = Walk(cash, held, fee_rate, tolerance)
        _passed(rows, walk)
        by = {t: q - held.get(t, 0) for t, q in walk.held.items() if q != held.get(t, 0)}
        return pd.DataFrame([{"account": rows["account"].iloc[0], "slice": int(rows["slice"].iloc[0]), "cash": cash, "held": held, "cash_by": walk.cash - cash,
                              "cash_low": walk.cash_low, "cash_high": walk.cash_high, "held_by": by, "held_low": walk.held_low, "held_high": walk.held_high}])

    def holds(row, cash: float, held: dict[str, int]) -> bool:
        own = dict(row.held)
        if cash == row.cash and {t: q for t, q in held.items() if q} == {t: q for t, q in own.items() if q}:
            return True
        off, margin = cash - row.cash, NEAR * max(1.0, abs(cash))
        moved = lambda t: held.get(t, 0) - own.get(t, 0)
        return (row.cash_low + margin <= off <= row.cash_high - margin and all(moved(t) >= low for t, low in dict(row.held_low).items())
                and all(moved(t) < high for t, high in dict(row.held_high).items()))

    def chained(summaries: pd.DataFrame) -> pd.DataFrame:
        cash, held, rows = initial_cash, {}, []
        for row in summaries.sort_values("slice").itertuples(index=False):
            rows.append((row.account, row.slice, cash, dict(held), not holds(row, cash, held)))
            cash += row.cash_by
            for ticker, by in dict(row.held_by).items():
                held[ticker] = max(0, held.get(ticker, 0) + by)
        return pd.DataFrame(rows, columns=["account", "slice", "cash", "held", "off"])

    keys = ["account", "slice"]
    walked = lambda starts, step, schema: orders.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(step, schema)
    guess = stage(orders.select(*keys).distinct().select(*keys, F.lit(float(initial_cash)).alias("cash"), F.expr("cast(map() as map<string,bigint>)").alias("held")), "guesses")
    known = stage(walked(guess, summary, result), "slices")
    for walked_again in range(ROUNDS + 1):
        starts = stage(known.groupBy("account").applyInPandas(chained, state + ", off boolean"), "starts")
        wrong = starts.filter("off").drop("off")
        if walked_again == ROUNDS or wrong.isEmpty():
            break
        needed = orders.join(wrong.select(*keys), keys, "left_semi")
        again = needed.groupBy(*keys).cogroup(wrong.groupBy(*keys)).applyInPandas(summary, result)
        known = stage(known.join(wrong.select(*keys), keys, "left_anti").unionByName(again), "slices")

    def final(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        walk = Walk(float(start["cash"].iloc[0]), dict(start["held"].iloc[0]), fee_rate, tolerance)
        return _passed(rows, walk).drop(columns="slice")

    first = wrong.groupBy("account").agg(F.min_by(F.struct("slice", "cash", "held"), "slice").alias("_s")).select(
        "account", F.col("_s.slice").alias("_from"), F.col("_s.cash").alias("cash"), F.col("_s.held").alias("held"))
    first = stage(first, "first")
    if first.isEmpty():
        return walked(starts.drop("off"), final, out)
    proven = starts.drop("off").join(first.select("account", "_from"), "account", "left").filter("_from IS NULL OR slice < _from").drop("_from")
    rest = orders.join(first, "account").filter(F.col("slice") >= F.col("_from"))
    done = orders.join(proven.select(*keys), keys, "left_semi").groupBy(*keys).cogroup(proven.groupBy(*keys)).applyInPandas(final, out)
    return done.unionByName(_walk_in_order(rest.select(*ORDER, "cash", "held"), initial_cash, fee_rate, tolerance, out))


def replay(orders: DataFrame, initial_cash: float, fee_rate: float = FEE_RATE, tolerance: float = 0.01, chunk: int = CHUNK) -> DataFrame:
    """Accept or reject each order of an account in order: no overspending, no overselling.

    Whether an order is accepted depends on every earlier one of the account.  Accounts of up to ``chunk`` orders are
    walked in order, many to a task.  Larger ones are cut into slices that are walked side by side and made consistent.
    """
    rows = orders.select(*ORDER)
    out = rows.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + REPLAYED
    hot = stage(rows.groupBy("account").count().filter(F.col("count") > chunk).select("account"), "hot")
    if hot.isEmpty():
        return _walk_in_order(rows, initial_cash, fee_rate, tolerance, out)
    large = stage(sliced(rows.join(hot, "account", "left_semi"), chunk), "large")
    small = _walk_in_order(rows.join(hot, "account", "left_anti"), initial_cash, fee_rate, tolerance, out)
    return small.unionByName(_replay_slices(large, initial_cash, fee_rate, tolerance, out))


def valuation(holdings: DataFrame, latest: DataFrame) -> DataFrame:
    """Open positions at the latest price; ``latest`` has ticker, date, price, raw_close."""
    c = F.col
    out = holdings.filter("quantity > 0").join(latest, "ticker")
    out = out.withColumns({"average_cost": c("cost_basis") / c("quantity"), "market_value": c("price") * c("quantity")})
    return out.withColumn("unrealized_pnl", c("market_value") - c("cost_basis")).withColumn(
        "unrealized_return", F.try_divide("unrealized_pnl", "cost_basis"))


def account_summary(accounts: DataFrame, valued: DataFrame, realized: DataFrame, initial_cash: float) -> DataFrame:
    marks = valued.groupBy("account").agg(F.sum("market_value").alias("market_value"),
                                          F.sum("unrealized_pnl").alias("unrealized_pnl"))
    gains = realized.groupBy("account").agg(F.sum("realized_pnl").alias("realized_pnl"))
    out = accounts.join(marks, "account", "left").join(gains, "account", "left").fillna(
        0.0, ["market_value", "unrealized_pnl", "realized_pnl"])
    return out.withColumn("equity", F.col("cash") + F.col("market_value")).withColumn(
        "total_return", F.col("equity") / initial_cash - 1)


def mark_to_market(valued: DataFrame, quotes: DataFrame) -> DataFrame:
    """Re-mark with fresh quotes on the adjusted basis; everything else keeps its end-of-day mark."""
    c = F.col
    live = F.coalesce(c("fresh") & (c("raw_close") > 0) & (c("price_vnd") > 0), F.lit(False))
    out = valued.join(quotes.select("ticker", "fresh", "price_vnd"), "ticker", "left")
    out = out.withColumns({
        "price_source": F.when(live, "LIVE_ADJUSTED_ESTIMATE").otherwise("EOD_ADJUSTED"),
        "price": F.when(live, c("price_vnd") * c("price") / c("raw_close")).otherwise(c("price"))})
    out = out.withColumn("market_value", c("price") * c("quantity"))
    out = out.withColumn("unrealized_pnl", c("market_value") - c("cost_basis"))
    return out.withColumn("unrealized_return", F.try_divide("unrealized_pnl", "cost_basis")).drop("fresh", "price_vnd")


def quote_board(tickers: DataFrame, ticks: DataFrame, eod: DataFrame, now: Column) -> DataFrame:
    """Fresh trade (quoted in thousands) per ticker, else the last close, else nothing."""
    age = now.cast("double") - F.col("ts").cast("double")
    fresh = ticks.filter((age >= -120) & (age <= 900) & (F.col("price") > 0))
    newest = fresh.groupBy("ticker").agg(F.max_by("price", F.struct("ts", "tick_id")).alias("_p"), F.max("ts").alias("trade_time"))
    out = tickers.join(newest, "ticker", "left").join(eod.select("ticker", F.col("close").alias("_c"), F.col("date").alias("_d")), "ticker", "left")
    live, closed = F.col("_p").isNotNull(), F.coalesce(F.col("_c") > 0, F.lit(False))
    return out.select("ticker", F.when(live, F.col("_p") * 1000).when(closed, F.col("_c")).alias("price_vnd"),
                      F.when(live, "REALTIME").when(closed, "EOD_FALLBACK").otherwise("UNAVAILABLE").alias("source"),
                      "trade_time", live.alias("fresh"), F.when(~live & closed, F.col("_d")).alias("eod_date"))


def position_exit_action(holdings: DataFrame, signals: DataFrame, ordinals: DataFrame, strategy) -> DataFrame:
    """What each account's position asks for today, with the conditions behind it."""
    c = F.col
    ma, trail = c(f"ma{strategy.exit_ma}"), c("high_close60") * (1 - strategy.trailing_stop)
    out = holdings.join(signals, "ticker", "left")
    out = session_number_asof(session_number_asof(out, "entry_date", ordinals, "_from"), "signal_date", ordinals, "_to")
    false = F.lit(False)
    known = c("final_action").isNotNull()
    has_data = F.coalesce(c("s_price") > 0, false) & ma.isNotNull()
    ma_hit = F.coalesce(has_data & (c("s_price") < ma), false)
    trail_hit = F.coalesce(c("s_price") < trail, false)
    score_hit = F.coalesce(c("unified_score") < strategy.exit_score, false)
    market_hit = F.lit(strategy.exit_on_market_regime) & ~F.coalesce(c("market_bull"), false)
    sessions = F.greatest(F.coalesce(c("_to") - c("_from"), F.lit(0)), F.lit(0))
    eligible = score_hit & (sessions >= strategy.minimum_holding_days)
    fresh = F.coalesce(c("price_fresh"), false)
    action = (F.when(~known | ~has_data | ~fresh, "DATA_REVIEW")
              .when(ma_hit | trail_hit | market_hit | eligible, "EXIT").otherwise("HOLD"))
    conditions = F.array(
        F.struct(F.lit("PRICE_BELOW_MA").alias("code"), ma_hit.alias("triggered"), ma_hit.alias("eligible")),
        F.struct(F.lit("TRAILING_STOP_60D").alias("code"), trail_hit.alias("triggered"), trail_hit.alias("eligible")),
        F.struct(F.lit("SCORE_BELOW_EXIT").alias("code"), score_hit.alias("triggered"), eligible.alias("eligible")))
    empty = F.filter(conditions, lambda x: F.lit(False))
    return out.select("account", "ticker", "quantity", "entry_date", sessions.alias("holding_sessions"),
                      c("final_action").alias("model_signal_action"), action.alias("position_action"),
                      F.when(known, conditions).otherwise(empty).alias("exit_conditions"))

