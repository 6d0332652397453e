"""Account ledgers, valuation and quotes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators import ledger as lg
from tapeframe.operators.ranking import first_per_key
from tapeframe.operators.windows import session_ordinals
from tapeframe.params import ON_FIXTURES
from tapeframe.plans.registry import query, rounded, sql_round, view
from tapeframe.plans.signals import signals
from tapeframe.runtime import stage
from tapeframe.sources.driver import Market

CASH = 5000.0
# Small slices, so that the test tables exercise the folding of several.
SLICE = 2000

view("led_orders", """
SELECT *, price * quantity AS gross, round(price * quantity * 0.0015 + 1e-9, 2) AS fee,
       row_number() OVER (PARTITION BY account ORDER BY id) AS n, CAST(substr(ticker, 2) AS INT) + 1 AS slot FROM fx_trades
""")
view("led_replay", f"""
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT account, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST({CASH} AS DOUBLE) AS money,
         [0, 0, 0, 0, 0]::BIGINT[] AS held, CAST(NULL AS VARCHAR) AS status
  FROM (SELECT DISTINCT account FROM led_orders)
  UNION ALL
  SELECT account, n, id, CASE WHEN status <> 'ACCEPTED' THEN money WHEN side = 'BUY' THEN money - (gross + fee) ELSE money + (gross - fee) END,
         CASE WHEN status <> 'ACCEPTED' THEN held ELSE list_transform(held, lambda h, i: CASE WHEN i = slot THEN h + CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END ELSE h END) END,
         status
  FROM (SELECT w.account, o.n, o.id, o.side, o.gross, o.fee, o.slot, o.quantity, w.money, w.held,
               CASE WHEN o.side = 'BUY' THEN CASE WHEN w.money - o.gross - o.fee >= -0.01 THEN 'ACCEPTED' ELSE 'OVERSPEND' END
                    ELSE CASE WHEN w.held[o.slot] >= o.quantity THEN 'ACCEPTED' ELSE 'OVERSELL' END END AS status
        FROM walk w JOIN led_orders o ON o.account = w.account AND o.n = w.n + 1))
  SELECT w.account, w.id, w.money AS cash_after, w.status, o.side, o.ticker, o.quantity, o.price, o.gross, o.fee, o.market_date
  FROM walk w JOIN led_orders o ON o.id = w.id)
""")
view("led_trades", """
SELECT *, row_number() OVER (PARTITION BY account, ticker ORDER BY id) AS k FROM led_replay WHERE status = 'ACCEPTED'
""")
view("led_positions", """
SELECT account, ticker, quantity, cost_basis, realized_pnl FROM (WITH RECURSIVE fold AS (
  SELECT account, ticker, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS quantity, CAST(0 AS DOUBLE) AS cost_basis, CAST(0 AS DOUBLE) AS realized_pnl
  FROM (SELECT DISTINCT account, ticker FROM led_trades)
  UNION ALL
  SELECT f.account, f.ticker, t.k, f.quantity + CASE WHEN t.side = 'BUY' THEN t.quantity ELSE -t.quantity END,
         CASE WHEN t.side = 'BUY' THEN f.cost_basis + t.gross + t.fee ELSE f.cost_basis / f.quantity * (f.quantity - t.quantity) END,
         CASE WHEN t.side = 'BUY' THEN f.realized_pnl ELSE f.realized_pnl + t.gross - t.fee - f.cost_basis / f.quantity * t.quantity END
  FROM fold f JOIN led_trades t ON t.account = f.account AND t.ticker = f.ticker AND t.k = f.k + 1)
  SELECT *, row_number() OVER (PARTITION BY account, ticker ORDER BY k DESC) AS rn FROM fold) WHERE rn = 1
""")


def accepted(market: Market) -> DataFrame:
    done = lg.replay(market.trades, CASH).filter("status = 'ACCEPTED'")
    return stage(done, "accepted_trades")


def latest_prices(market: Market) -> DataFrame:
    return first_per_key(market.bars, ["ticker"], [F.col("date").desc()]).select(
        "ticker", "date", F.col("close").alias("price"), F.col("close").alias("raw_close"))


@query("ledger_replay", "SELECT id, account, side, ticker, quantity, status, round(cash_after, 2) AS cash_after, round(fee, 2) AS fee FROM led_replay")
def ledger_replay(spark, folder):
    return lg.replay(Market(spark, folder).trades, CASH).select(
        "id", "account", "side", "ticker", "quantity", "status", F.round("cash_after", 2).alias("cash_after"),
        F.round("fee", 2).alias("fee"))


_HELD = "[0, 0, 0, 0, 0]::BIGINT[]"


@query("ledger_replay_hot", f"""
SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT *, account % 3 AS acc, row_number() OVER (PARTITION BY account % 3 ORDER BY id) AS k FROM led_orders),
walk AS (
  SELECT acc, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST({CASH * 20} AS DOUBLE) AS money, {_HELD} AS held, CAST(NULL AS VARCHAR) AS status FROM (SELECT DISTINCT acc FROM o)
  UNION ALL
  SELECT acc, k, id, CASE WHEN status <> 'ACCEPTED' THEN money WHEN side = 'BUY' THEN money - (gross + fee) ELSE money + (gross - fee) END,
         CASE WHEN status <> 'ACCEPTED' THEN held ELSE list_transform(held, lambda h, i: CASE WHEN i = slot THEN h + CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END ELSE h END) END, status
  FROM (SELECT w.acc, o.k, o.id, o.side, o.gross, o.fee, o.slot, o.quantity, w.money, w.held,
               CASE WHEN o.side = 'BUY' THEN CASE WHEN w.money - o.gross - o.fee >= -0.01 THEN 'ACCEPTED' ELSE 'OVERSPEND' END
                    ELSE CASE WHEN w.held[o.slot] >= o.quantity THEN 'ACCEPTED' ELSE 'OVERSELL' END END AS status
        FROM walk w JOIN o ON o.acc = w.acc AND o.k = w.k + 1))
SELECT acc AS account, id, status, round(money, 2) AS cash_after FROM walk WHERE k > 0)
""")
def ledger_replay_hot(spark, folder):
    """All orders on three accounts, each cut into slices that are walked side by side."""
    trades = Market(spark, folder).trades
    few = trades.withColumn("account", F.col("account") % 3)
    return lg.replay(few, CASH * 20, chunk=SLICE // 4).select("account", "id", "status", F.round("cash_after", 2).alias("cash_after"))


@query("ledger_positions", f"SELECT account, ticker, quantity, {sql_round(['cost_basis', 'realized_pnl'], 6)} FROM led_positions")
def ledger_positions(spark, folder):
    return lg.positions(accepted(Market(spark, folder)), SLICE).select(
        "account", "ticker", "quantity", *rounded(["cost_basis", "realized_pnl"], 6))


@query("ledger_cash", f"""
SELECT account, round({CASH} + sum(CASE WHEN side = 'BUY' THEN -(gross + fee) ELSE gross - fee END), 2) AS cash, count(*) AS trades
FROM led_trades GROUP BY account
""")
def ledger_cash(spark, folder):
    return lg.cash(accepted(Market(spark, folder)), CASH).withColumn("cash", F.round("cash", 2))


view("led_entries", """
SELECT account, ticker, max(quantity) AS quantity, CASE WHEN max(quantity) > 0 THEN arg_max(entry, id) FILTER (entry IS NOT NULL) END AS entry_date
FROM (SELECT account, ticker, id, CASE WHEN run > 0 AND run - d <= 0 THEN market_date END AS entry, sum(d) OVER (PARTITION BY account, ticker)::BIGINT AS quantity
      FROM (SELECT *, sum(d) OVER (PARTITION BY account, ticker ORDER BY id) AS run
            FROM (SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS d FROM led_trades)))
GROUP BY account, ticker
""")


@query("entry_crossing", "SELECT account, ticker, quantity, entry_date FROM led_entries")
def entry_crossing(spark, folder):
    return lg.entry_dates(accepted(Market(spark, folder)), SLICE)


view("led_valued", """
SELECT p.account, p.ticker, p.quantity, p.cost_basis, b.date, b.close AS price, b.close AS raw_close, p.cost_basis / p.quantity AS average_cost,
       b.close * p.quantity AS market_value, b.close * p.quantity - p.cost_basis AS unrealized_pnl,
       (b.close * p.quantity - p.cost_basis) / nullif(p.cost_basis, 0) AS unrealized_return
FROM led_positions p JOIN fx_last_bar b ON b.ticker = p.ticker WHERE p.quantity > 0
""")
VALUED = ["average_cost", "market_value", "unrealized_pnl", "unrealized_return"]


@query("portfolio_valuation", f"""
SELECT a.account, round(a.cash, 2) AS cash, {sql_round(['market_value', 'unrealized_pnl', 'realized_pnl', 'equity', 'total_return'], 5)}
FROM (SELECT a.account, a.cash, coalesce(v.mv, 0) AS market_value, coalesce(v.u, 0) AS unrealized_pnl, coalesce(r.g, 0) AS realized_pnl,
             a.cash + coalesce(v.mv, 0) AS equity, (a.cash + coalesce(v.mv, 0)) / {CASH} - 1 AS total_return
      FROM (SELECT account, {CASH} + sum(CASE WHEN side = 'BUY' THEN -(gross + fee) ELSE gross - fee END) AS cash FROM led_trades GROUP BY account) a
      LEFT JOIN (SELECT account, sum(market_value) AS mv, sum(unrealized_pnl) AS u FROM led_valued GROUP BY account) v ON v.account = a.account
      LEFT JOIN (SELECT account, sum(realized_pnl) AS g FROM led_positions GROUP BY account) r ON r.account = a.account) a
""")
def portfolio_valuation(spark, folder):
    market = Market(spark, folder)
    trades = accepted(market)
    held = stage(lg.positions(trades, SLICE), "positions")
    valued = lg.valuation(held, latest_prices(market))
    out = lg.account_summary(lg.cash(trades, CASH), valued, held, CASH)
    return out.select("account", F.round("cash", 2).alias("cash"),
                      *rounded(["market_value", "unrealized_pnl", "realized_pnl", "equity", "total_return"], 5))


@query("position_valuation", f"SELECT account, ticker, quantity, date, price, {sql_round(VALUED, 5)} FROM led_valued")
def position_valuation(spark, folder):
    market = Market(spark, folder)
    valued = lg.valuation(lg.positions(accepted(market), SLICE), latest_prices(market))
    return valued.select("account", "ticker", "quantity", "date", "price", *rounded(VALUED, 5))


view("board", """
SELECT c.ticker, CASE WHEN t.p IS NOT NULL THEN t.p * 1000 WHEN b.close > 0 THEN b.close END AS price_vnd,
       CASE WHEN t.p IS NOT NULL THEN 'REALTIME' WHEN b.close > 0 THEN 'EOD_FALLBACK' ELSE 'UNAVAILABLE' END AS source,
       t.trade_time, t.p IS NOT NULL AS fresh, CASE WHEN t.p IS NULL AND b.close > 0 THEN b.date END AS eod_date
FROM fx_companies c LEFT JOIN (
  SELECT ticker, arg_max(price, (ts, tick_id)) AS p, max(ts) AS trade_time FROM fx_ticks, (SELECT max(ts) AS now FROM fx_ticks)
  WHERE price > 0 AND epoch(now) - epoch(ts) BETWEEN -120 AND 900 GROUP BY ticker) t ON t.ticker = c.ticker
LEFT JOIN fx_last_bar b ON b.ticker = c.ticker
""")


def board(market: Market) -> DataFrame:
    now = market.ticks.select(F.max("ts")).scalar()
    eod = latest_prices(market).select("ticker", F.col("price").alias("close"), "date")
    return lg.quote_board(market.companies.select("ticker"), market.ticks, eod, now)


@query("quote_board", "SELECT * FROM board")
def quote_board(spark, folder):
    return board(Market(spark, folder))


@query("trade_fresh", """
SELECT tick_id, ticker, price FROM fx_ticks, (SELECT max(ts) AS now FROM fx_ticks) WHERE epoch(now) - epoch(ts) BETWEEN -120 AND 900
""")
def trade_fresh(spark, folder):
    market = Market(spark, folder)
    age = market.ticks.select(F.max("ts")).scalar().cast("double") - F.col("ts").cast("double")
    return market.ticks.filter((age >= -120) & (age <= 900)).select("tick_id", "ticker", "price")


@query("mark_to_market", f"""
SELECT account, ticker, quantity, price_source, {sql_round(['price', 'market_value', 'unrealized_pnl', 'unrealized_return'], 5)}
FROM (SELECT *, price * quantity AS market_value, price * quantity - cost_basis AS unrealized_pnl,
             (price * quantity - cost_basis) / nullif(cost_basis, 0) AS unrealized_return
      FROM (SELECT v.account, v.ticker, v.quantity, v.cost_basis, CASE WHEN q.fresh THEN 'LIVE_ADJUSTED_ESTIMATE' ELSE 'EOD_ADJUSTED' END AS price_source,
                   CASE WHEN q.fresh THEN q.price_vnd * v.price / v.raw_close ELSE v.price END AS price
            FROM led_valued v LEFT JOIN board q ON q.ticker = v.ticker))
""")
def mark_to_market(spark, folder):
    market = Market(spark, folder)
    valued = lg.valuation(lg.positions(accepted(market), SLICE), latest_prices(market))
    return lg.mark_to_market(valued, board(market)).select(
        "account", "ticker", "quantity", "price_source",
        *rounded(["price", "market_value", "unrealized_pnl", "unrealized_return"], 5))


_SHIFT = 276  # The order log is 23 years after the bars.
view("exit_checks", f"""
SELECT *, has_data AND price < ma200 AS ma_hit, coalesce(price < high_close60 * 0.85, false) AS trail_hit, coalesce(unified_score < 35, false) AS score_hit,
       coalesce(unified_score < 35, false) AND sessions >= 10 AS eligible
FROM (SELECT e.account, e.ticker, e.quantity, CAST(e.entry_date - INTERVAL {_SHIFT} MONTH AS DATE) AS entry_date, s.final_action, s.price, s.ma200,
             s.high_close60, s.unified_score, s.price_fresh, coalesce(s.price > 0, false) AND s.ma200 IS NOT NULL AS has_data,
             (SELECT count(*) FROM fx_sessions x WHERE x.date > CAST(e.entry_date - INTERVAL {_SHIFT} MONTH AS DATE) AND x.date <= s.signal_date) AS sessions
      FROM led_entries e LEFT JOIN fx_signals s ON s.ticker = e.ticker WHERE e.quantity > 0)
""")


@query("position_exit_action", """
SELECT account, ticker, quantity, entry_date, sessions AS holding_sessions, final_action AS model_signal_action,
       CASE WHEN final_action IS NULL OR NOT has_data OR NOT price_fresh THEN 'DATA_REVIEW' WHEN ma_hit OR trail_hit OR eligible THEN 'EXIT' ELSE 'HOLD' END AS position_action,
       coalesce(ma_hit, false) AS ma_hit, trail_hit, score_hit, eligible AS score_eligible FROM exit_checks
""")
def position_exit_action(spark, folder):
    market = Market(spark, folder)
    held = lg.entry_dates(accepted(market), SLICE).filter("quantity > 0").withColumn(
        "entry_date", F.add_months("entry_date", -_SHIFT))
    today = signals(market).select("ticker", "signal_date", F.col("price").alias("s_price"), "ma200", "high_close60",
                                   "unified_score", "price_fresh", "market_bull", "final_action")
    out = lg.position_exit_action(held, today, session_ordinals(market.staged_bars), ON_FIXTURES)
    condition = lambda i, f: F.col("exit_conditions")[i][f]
    return out.select("account", "ticker", "quantity", "entry_date", "holding_sessions", "model_signal_action", "position_action",
                      condition(0, "triggered").alias("ma_hit"), condition(1, "triggered").alias("trail_hit"),
                      condition(2, "triggered").alias("score_hit"), condition(2, "eligible").alias("score_eligible"))
