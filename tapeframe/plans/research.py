"""Evaluation and parameter-research queries."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.operators import fundamentals as fa_ops
from tapeframe.operators import research as rs
from tapeframe.operators.windows import by_date, session_ordinals
from tapeframe.params import ON_FIXTURES
from tapeframe.plans.registry import query, rounded, view
from tapeframe.plans.signals import history
from tapeframe.plans.windows import W
from tapeframe.runtime import stage
from tapeframe.sources.driver import Market

BASE = ON_FIXTURES.with_(entry_score=40.0, max_positions=5)
# The axes of the search that a set-based return depends on.
AXES = {"fa_weight": (0.1, 0.2, 0.3, 0.4), "profile": tuple(rs.PROFILES), "entry_score": (30.0, 40.0, 50.0), "minimum_volume_ratio": (0.8, 1.0, 1.2),
        "regime_ma": (50, 100, 200), "max_positions": (5, 10, 20), "minimum_trading_value": (BASE.minimum_trading_value, 2 * BASE.minimum_trading_value)}
SAMPLE = 384  # configurations of a published search
GRID = rs.grid(BASE, AXES, SAMPLE)
ABLATIONS = rs.ablations(BASE)
EXPERIMENTS = rs.experiments(BASE)
BASELINE = [rs.config(0, "baseline", BASE)]
PERIODS = [("train", "1997-01-01", "1999-12-31"), ("validation", "2000-01-01", "2000-12-31"),
           ("stress", "2001-01-01", "2099-12-31"), ("full", "1900-01-01", "2099-12-31")]
CUTOFFS = [1999, 2000, 2001]
EXTRA_COST = 0.0015  # doubles the one-way cost


NEIGHBOURS = rs.neighbours(GRID[0], 1000)


def _flag(text: str) -> str:
    return f"CAST(coalesce({text}, false) AS INT)::DOUBLE"


view("rs_hist", f"""
SELECT t.*, a.effective_fa, a.fa_eligible, lead(2000 + px / 100, 1) {W.replace('ticker', 't.ticker').replace('date', 't.date')}) AS px1,
       lead(2000 + px / 100, 2) {W.replace('ticker', 't.ticker').replace('date', 't.date')}) AS px2,
       lag(volatility20) {W.replace('ticker', 't.ticker').replace('date', 't.date')}) AS prev_vol,
       lag(avg_trading_value20) {W.replace('ticker', 't.ticker').replace('date', 't.date')}) AS prev_adv,
       0.0::DOUBLE + coalesce(r3, -10.0) * 0.15::DOUBLE + coalesce(r6, -10.0) * 0.3::DOUBLE + coalesce(r12, -10.0) * 0.35::DOUBLE
         + coalesce(rs6, -10.0) * 0.2::DOUBLE AS strength
FROM fx_ta t JOIN fx_asof_fa a ON a.ticker = t.ticker AND a.date = t.date
""")
view("fx_asof_fa_late", """
SELECT b.ticker, b.date, a.effective_fa, coalesce(e.fa_eligible, false) AS fa_eligible
FROM fx_bars b
ASOF LEFT JOIN (SELECT * REPLACE (effective_date + 90 AS effective_date) FROM fx_panel WHERE effective_fa IS NOT NULL) a
  ON a.ticker = b.ticker AND b.date >= a.effective_date
ASOF LEFT JOIN (SELECT * REPLACE (effective_date + 90 AS effective_date) FROM fx_panel) e ON e.ticker = b.ticker AND b.date >= e.effective_date
""")
view("rs_hist_late", """
SELECT h.* REPLACE (l.effective_fa AS effective_fa, l.fa_eligible AS fa_eligible) FROM rs_hist h
JOIN fx_asof_fa_late l ON l.ticker = h.ticker AND l.date = h.date
""")


def _register_sweep(p: str, configs: list[dict] | str, source: str = "rs_hist") -> None:
    """Views of a sweep in SQL over listed configurations, or over those a statement selects."""
    if isinstance(configs, str):
        view(f"{p}_cfg", configs)
    else:
        _list_configs(p, configs)
    _sweep_views(p, source)


def _list_configs(p: str, configs: list[dict]) -> None:
    rows = ", ".join("(" + ", ".join(repr(c[k]) if k == "name" else f"{c[k]!r}::DOUBLE" if isinstance(c[k], float) else str(c[k])
                                     for k in rs.CONFIG_FIELDS) + ")" for c in configs)
    view(f"{p}_cfg", f"SELECT * FROM (VALUES {rows}) AS t({', '.join(rs.CONFIG_FIELDS)})")


def _sweep_views(p: str, source: str) -> None:
    view(f"{p}_panel", f"""
SELECT * FROM (
  SELECT c.config, h.ticker, h.date, h.strength, h.px, h.px1, h.px2, h.prev_vol, h.prev_adv, c.max_positions, c.cost, c.vol_target, c.entry_score,
    h.effective_fa * c.fa_weight + (0.0::DOUBLE + {_flag('r3 > 0 AND r6 > 0 AND r12 > 0')} * c.momentum + {_flag('rs6 > 0')} * c.relative_strength
      + {_flag('px > ma50 AND ma50 > ma200')} * c.trend + {_flag('px > high_close20')} * c.breakout
      + {_flag('h.volume_ratio >= c.volume_ratio')} * c.volume) * (1 - c.fa_weight) AS score
  FROM {source} h CROSS JOIN {p}_cfg c
  WHERE r12 IS NOT NULL AND ma200 IS NOT NULL AND effective_fa IS NOT NULL AND fa_eligible AND avg_trading_value20 >= c.liquidity
    AND bm_px >= CASE c.regime_ma WHEN 50 THEN bm_ma50 WHEN 100 THEN bm_ma100 ELSE bm_ma200 END)
WHERE score >= entry_score
""")
    view(f"{p}_members", f"""
SELECT m.*, s.session, CASE WHEN vol_target <= 0 THEN 1.0 WHEN prev_vol > 0 THEN least(1.0, vol_target / prev_vol) ELSE 0.0 END / max_positions AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY config, date ORDER BY round(score, 6) DESC, round(strength, 6) DESC, ticker) AS rank FROM {p}_panel) m
JOIN fx_sessions s ON s.date = m.date WHERE rank <= max_positions
""")
    view(f"{p}_daily", f"""
SELECT c.config, s.date, s.session, coalesce(t.gain, 0) - c.cost * (coalesce(t.came, 0) + coalesce(g.went, 0)) / c.max_positions AS ret,
       (coalesce(t.came, 0) + coalesce(g.went, 0)) / c.max_positions::DOUBLE AS turnover, coalesce(t.holdings, 0) AS holdings,
       1 - coalesce(t.exposure, 0) AS cash_weight, t.came AS buys
FROM fx_sessions s CROSS JOIN {p}_cfg c
LEFT JOIN (SELECT m.config, m.session, sum(coalesce(m.px2 / nullif(m.px1, 0) - 1, 0) * m.weight) AS gain, count(*) AS holdings, sum(m.weight) AS exposure,
                  count(*) FILTER (b.ticker IS NULL) AS came
           FROM {p}_members m LEFT JOIN {p}_members b ON b.config = m.config AND b.ticker = m.ticker AND b.session = m.session - 1 GROUP BY ALL) t
  ON t.config = c.config AND t.session = s.session
LEFT JOIN (SELECT m.config, m.session + 1 AS session, count(*) AS went
           FROM {p}_members m LEFT JOIN {p}_members n ON n.config = m.config AND n.ticker = m.ticker AND n.session = m.session + 1
           WHERE n.ticker IS NULL GROUP BY ALL) g ON g.config = c.config AND g.session = s.session
""")


for _p, _configs in (("base", BASELINE), ("sw", GRID), ("abl", ABLATIONS), ("exq", EXPERIMENTS), ("nbr", NEIGHBOURS)):
    _register_sweep(_p, _configs)
_register_sweep("lag", GRID, "rs_hist_late")

METRICS = ["cagr", "sharpe", "maximum_drawdown", "annual_turnover", "average_positions"]


def sql_metrics(source: str, by: str, strict: bool = True) -> str:
    growth = "CASE WHEN arg_max(equity, date) > 0 THEN pow(arg_max(equity, date), 252.0 / count(*)) - 1 END"
    sharpe = "CASE WHEN stddev_pop(ret) > 1e-12 THEN sqrt(252.0) * avg(ret) / stddev_pop(ret) END"
    if not strict:
        growth, sharpe = f"coalesce({growth}, -1)", f"coalesce({sharpe}, 0)"
    return f"""
SELECT {by}, count(*) AS sessions, {growth} AS cagr, {sharpe} AS sharpe, min(drawdown) AS maximum_drawdown,
       sum(turnover) / (count(*) / 252.0) AS annual_turnover, avg(holdings) AS average_positions
FROM (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY {by} ORDER BY date)) - 1 AS drawdown
      FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {by} ORDER BY date) AS equity FROM ({source}))) GROUP BY {by}"""


def research_history(market: Market, lag_days: int | None = None, features: DataFrame | None = None) -> DataFrame:
    """Features with point-in-time scores, and the price that fills orders; ``features`` are the market's own, if made already.

    The driver's prices are noise without a level; the fill price damps them so that
    compounded results stay in a readable range.
    """
    panel = fa_ops.fa_panel(market.companies, market.fin_wide, ON_FIXTURES, lag_days)
    return fa_ops.asof_fa(panel, history(market) if features is None else features).withColumn("fill", damped(F.col("px")))


def damped(price):
    return 2000 + price / 100


def calendar_of(market: Market) -> DataFrame:
    return stage(session_ordinals(market.staged_bars), "calendar")


def daily_of(market: Market, configs: list[dict], lag_days: int | None = None) -> DataFrame:
    return stage(rs.sweep(research_history(market, lag_days), calendar_of(market), configs, fill="fill"), "daily")


def picked_of(market: Market, configs: list[dict]) -> DataFrame:
    most = max(c["max_positions"] for c in configs)
    return rs.members(rs.sweep_panel(research_history(market), configs, most=most), most)


@query("cross_config_panel", "SELECT config, date, count(*) AS entries, round(max(score) + 1e-9, 6) AS best FROM sw_panel GROUP BY config, date")
def cross_config_panel(spark, folder):
    """Bars under every configuration that would enter them, summarised per configuration and session."""
    panel = rs.sweep_panel(research_history(Market(spark, folder)), GRID)
    return panel.groupBy("config", "date").agg(F.count("*").alias("entries"), F.max("score").alias("best")).select(
        "config", "date", "entries", *rounded(["best"], 6))


@query("config_grid", """
SELECT c.config, c.name, c.entry_score, c.fa_weight, c.regime_ma, c.max_positions, count(p.ticker) AS entries
FROM sw_cfg c LEFT JOIN sw_panel p ON p.config = c.config GROUP BY ALL
""")
def config_grid(spark, folder):
    """The candidate configurations of the search and how many bars each would enter."""
    panel = rs.sweep_panel(research_history(Market(spark, folder)), GRID)
    rows = spark.createDataFrame([tuple(c[k] for k in ("config", "name", "entry_score", "fa_weight", "regime_ma", "max_positions"))
                                  for c in GRID], "config long, name string, entry_score double, fa_weight double, regime_ma long, max_positions long")
    counts = panel.groupBy("config").agg(F.count("*").alias("entries"))
    return rows.join(counts, "config", "left").fillna(0, ["entries"])


@query("config_variants", "SELECT 'ablation' AS family, c.name, count(p.ticker) AS entries FROM abl_cfg c LEFT JOIN abl_panel p ON p.config = c.config GROUP BY ALL "
       "UNION ALL SELECT 'experiment', c.name, count(p.ticker) FROM exq_cfg c LEFT JOIN exq_panel p ON p.config = c.config GROUP BY ALL "
       "UNION ALL SELECT 'neighbour', c.name, count(p.ticker) FROM nbr_cfg c LEFT JOIN nbr_panel p ON p.config = c.config GROUP BY ALL")
def config_variants(spark, folder):
    """Ablations, experiments and local neighbours of the baseline, each with the bars it would enter."""
    hist = stage(research_history(Market(spark, folder)), "history")
    out = None
    for family, configs in (("ablation", ABLATIONS), ("experiment", EXPERIMENTS), ("neighbour", NEIGHBOURS)):
        panel = rs.sweep_panel(hist, configs)
        names = spark.createDataFrame([(c["config"], c["name"]) for c in configs], "config long, name string")
        part = names.join(panel.groupBy("config").agg(F.count("*").alias("entries")), "config", "left").fillna(0, ["entries"]).select(
            F.lit(family).alias("family"), "name", "entries")
        out = part if out is None else out.unionByName(part)
    return out


@query("select_free_slots", "SELECT date, ticker, rank, round(score + 1e-9, 6) AS score FROM base_members")
def select_free_slots(spark, folder):
    """The best candidates of every session for the free slots of the baseline."""
    return picked_of(Market(spark, folder), BASELINE).select("date", "ticker", F.col("rank").cast("long").alias("rank"), *rounded(["score"], 6))


@query("sweep_scores", "SELECT config, date, ticker, rank, round(score + 1e-9, 6) AS score FROM sw_members")
def sweep_scores(spark, folder):
    return picked_of(Market(spark, folder), GRID).select(
        "config", "date", "ticker", F.col("rank").cast("long").alias("rank"), *rounded(["score"], 6))


@query("topn_returns", "SELECT date, round(ret, 8) AS ret, round(turnover, 8) AS turnover, holdings FROM base_daily")
def topn_returns(spark, folder):
    return daily_of(Market(spark, folder), BASELINE).select(
        "date", F.round("ret", 8).alias("ret"), F.round("turnover", 8).alias("turnover"), "holdings")


@query("vol_cap_weights", "SELECT config, date, ticker, round(weight, 8) AS weight FROM exq_members WHERE vol_target > 0")
def vol_cap_weights(spark, folder):
    rows = rs.with_weights(picked_of(Market(spark, folder), EXPERIMENTS).filter("vol_target > 0"))
    return rows.select("config", "date", "ticker", F.round("weight", 8).alias("weight"))


PORTFOLIO, PARTICIPATION = 20000.0, 0.05


@query("adv_capacity", f"""
SELECT date, count(*) AS orders, count(*) FILTER (NOT coalesce(weight * {PORTFOLIO} <= {PARTICIPATION} * prev_adv, false)) AS rejected,
       round(sum(weight * {PORTFOLIO}), 4) AS notional FROM base_members GROUP BY date
""")
def adv_capacity(spark, folder):
    """Orders larger than a share of the previous session's average traded value are rejected."""
    rows = rs.with_weights(picked_of(Market(spark, folder), BASELINE)).withColumn("notional", F.col("weight") * PORTFOLIO)
    fits = F.coalesce(F.col("notional") <= F.col("prev_adv") * PARTICIPATION, F.lit(False))
    return rows.groupBy("date").agg(F.count("*").alias("orders"), F.count(F.when(~fits, 1)).alias("rejected"),
                                    F.round(F.sum("notional"), 4).alias("notional"))


@query("performance", f"""
SELECT m.config, m.sessions, {', '.join(f'round({x}, 6) AS {x}' for x in METRICS)}, round(p.rate, 6) AS positive_month_rate
FROM ({sql_metrics('SELECT * FROM sw_daily', 'config')}) m
JOIN (SELECT config, avg((r > 0)::INT) AS rate FROM (SELECT config, date_trunc('month', date) AS mm, product(1 + ret) - 1 AS r FROM sw_daily GROUP BY ALL) GROUP BY config) p
  ON p.config = m.config
""")
def performance(spark, folder):
    daily = daily_of(Market(spark, folder), GRID)
    out = rs.metrics(daily, ["config"]).join(rs.positive_months(daily, ["config"]), "config")
    return out.select("config", "sessions", *[F.round(x, 6).alias(x) for x in [*METRICS, "positive_month_rate"]])


def sql_periods(source: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{n}' AS period FROM {source} WHERE date BETWEEN DATE '{a}' AND DATE '{b}'" for n, a, b in PERIODS)


@query("period_metrics", f"SELECT config, period, sessions, {', '.join(f'round({x}, 6) AS {x}' for x in METRICS)} FROM ({sql_metrics(sql_periods('sw_daily'), 'config, period')})")
def period_metrics(spark, folder):
    rows = rs.in_periods(daily_of(Market(spark, folder), GRID), PERIODS)
    return rs.metrics(rows, ["config", "period"]).select("config", "period", "sessions", *[F.round(x, 6).alias(x) for x in METRICS])


view("bm_daily", "SELECT date, coalesce((2000 + close / 100) / (2000 + lag(close) OVER (ORDER BY date) / 100) - 1, 0) AS ret, 0.0 AS turnover, 0 AS holdings FROM fx_benchmark")


def index_returns(market: Market) -> DataFrame:
    return rs.benchmark_returns(market.staged_benchmark.withColumn("close", damped(F.col("close"))))


@query("benchmark_alpha", f"""
SELECT s.config, round(s.cagr, 6) AS cagr, round(b.cagr, 6) AS benchmark_cagr, round(s.cagr - b.cagr, 6) AS alpha_cagr, round(b.sharpe, 6) AS benchmark_sharpe
FROM ({sql_metrics('SELECT * FROM base_daily', 'config')}) s, ({sql_metrics('SELECT *, 0 AS k FROM bm_daily', 'k')}) b
""")
def benchmark_alpha(spark, folder):
    market = Market(spark, folder)
    mine = rs.metrics(daily_of(market, BASELINE), ["config"])
    index = stage(rs.metrics(index_returns(market).withColumn("k", F.lit(0)), ["k"]), "index_metrics")
    cagr, sharpe = index.select("cagr").scalar(), index.select("sharpe").scalar()
    return mine.select("config", F.round("cagr", 6).alias("cagr"), F.round(cagr, 6).alias("benchmark_cagr"),
                       F.round(F.col("cagr") - cagr, 6).alias("alpha_cagr"), F.round(sharpe, 6).alias("benchmark_sharpe"))


@query("running_equity", f"""
SELECT ticker, date, round(product(1 + r) {W}), 6) AS equity FROM (SELECT ticker, date, close / lag(close) {W}) - 1 AS r FROM fx_bars) WHERE r IS NOT NULL
""")
def running_equity(spark, folder):
    return _own_equity(spark, folder).select("ticker", "date", F.round("equity", 6).alias("equity"))


def _own_equity(spark, folder) -> DataFrame:
    bars = Market(spark, folder).bars.withColumn("ret", F.col("close") / F.lag("close").over(by_date()) - 1)
    return rs.running_equity(bars.filter("ret IS NOT NULL"), ["ticker"], "ret")


@query("running_drawdown", f"""
SELECT ticker, date, round(e / greatest(1.0, max(e) {W})) - 1, 6) AS drawdown FROM (
  SELECT ticker, date, product(1 + r) {W}) AS e FROM (SELECT ticker, date, close / lag(close) {W}) - 1 AS r FROM fx_bars) WHERE r IS NOT NULL)
""")
def running_drawdown(spark, folder):
    return _own_equity(spark, folder).select("ticker", "date", F.round("drawdown", 6).alias("drawdown"))


view("held_line", """
SELECT b.ticker, b.date, b.close AS px, CASE WHEN m.ticker IS NOT NULL THEN 1 ELSE 0 END AS held
FROM fx_bars b LEFT JOIN abl_members m ON m.ticker = b.ticker AND m.date = b.date AND m.config = 0
""")
view("held_marks", f"""
SELECT *, row_number() {W}) AS bar, coalesce(lag(held) {W}), 0) AS was, lag(px) {W}) AS prev_px, count(*) OVER (PARTITION BY ticker) AS bars FROM held_line
""")
view("changes", f"""
SELECT e.*, x.bar AS exit_bar, x.date AS exit_date, x.px AS exit_price, x.prev_px AS exit_prev_price FROM (
  SELECT ticker, date AS entry_date, bar AS entry_bar, px AS entry_price, prev_px AS entry_prev_price, bars FROM held_marks WHERE held = 1 AND was = 0) e
LEFT JOIN held_marks x ON x.ticker = e.ticker AND x.bar = (SELECT min(y.bar) FROM held_marks y WHERE y.ticker = e.ticker AND y.bar > e.entry_bar AND y.held = 0 AND y.was = 1)
""")


def changes_of(market: Market) -> DataFrame:
    members = picked_of(market, BASELINE).select("ticker", "date", F.lit(1).alias("held"))
    line = market.staged_bars.select("ticker", "date", F.col("close").alias("px")).join(members, ["ticker", "date"], "left").fillna(0, ["held"])
    return rs.position_changes(line)


@query("position_changes", "SELECT ticker, entry_date, exit_date, entry_bar, exit_bar FROM changes")
def position_changes(spark, folder):
    return changes_of(Market(spark, folder)).select("ticker", "entry_date", "exit_date", "entry_bar", "exit_bar")


view("trade_led", """
SELECT ticker, entry_date, exit_date, CASE WHEN exit_bar IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, entry_price, exit_price,
       exit_price / entry_price - 1 AS gross_return, (1 + exit_price / entry_price - 1) * (1 - 0.0015) / (1 + 0.0015) - 1 AS net_return,
       CASE WHEN exit_bar IS NULL THEN bars - entry_bar ELSE exit_bar - entry_bar END AS holding_sessions FROM changes
""")


@query("trade_ledger", "SELECT * REPLACE (round(gross_return, 8) AS gross_return, round(net_return, 8) AS net_return) FROM trade_led")
def trade_ledger(spark, folder):
    out = rs.trade_ledger(changes_of(Market(spark, folder)), 0.0015)
    return out.withColumns({n: F.round(n, 8) for n in ("gross_return", "net_return")})


_STATS = ["winning_trade_rate", "average_trade_return_before_cost", "average_trade_return_after_cost", "average_win_return",
          "average_loss_return", "max_win_return", "max_loss_return"]


@query("ledger_statistics", f"""
SELECT trade_count, open_trade_count, {', '.join(f'round({x}, 6) AS {x}' for x in _STATS)} FROM (
  SELECT count(*) FILTER (status = 'CLOSED') AS trade_count, count(*) FILTER (status = 'OPEN') AS open_trade_count,
    avg((net_return > 0)::INT) FILTER (status = 'CLOSED') AS winning_trade_rate, avg(gross_return) FILTER (status = 'CLOSED') AS average_trade_return_before_cost,
    avg(net_return) FILTER (status = 'CLOSED') AS average_trade_return_after_cost, avg(net_return) FILTER (status = 'CLOSED' AND net_return > 0) AS average_win_return,
    avg(net_return) FILTER (status = 'CLOSED' AND net_return < 0) AS average_loss_return, max(net_return) FILTER (status = 'CLOSED' AND net_return > 0) AS max_win_return,
    min(net_return) FILTER (status = 'CLOSED' AND net_return < 0) AS max_loss_return FROM trade_led)
""")
def ledger_statistics(spark, folder):
    out = rs.ledger_statistics(rs.trade_ledger(changes_of(Market(spark, folder)), 0.0015))
    return out.select("trade_count", "open_trade_count", *[F.round(x, 6).alias(x) for x in _STATS])


@query("trade_statistics", """
SELECT count(v) AS trade_count, count(*) FILTER (exit_bar IS NULL) AS open_trade_count, round(avg((v > 0)::INT), 6) AS winning_trade_rate,
       round(avg(v), 6) AS average_trade_return_before_cost, round(avg(v) FILTER (v > 0), 6) AS average_win_return,
       round(avg(v) FILTER (v <= 0), 6) AS average_loss_return, round(max(v), 6) AS max_win_return, round(min(v), 6) AS max_loss_return
FROM (SELECT *, CASE WHEN entry_prev_price > 0 AND exit_bar IS NOT NULL THEN exit_prev_price / entry_prev_price - 1 END AS v FROM changes)
""")
def trade_statistics(spark, folder):
    out = rs.trade_statistics(changes_of(Market(spark, folder)))
    return out.select("trade_count", "open_trade_count", *[F.round(x, 6).alias(x) for x in out.columns[2:]])


@query("equity_curve", """
SELECT d.date, round(d.ret, 8) AS strategy_return, round(b.ret, 8) AS benchmark_return, round(d.turnover, 8) AS turnover, d.holdings AS positions,
       round(d.cash_weight, 8) AS cash_weight, round(product(1 + d.ret) OVER (ORDER BY d.date), 6) AS strategy_equity,
       round(product(1 + b.ret) OVER (ORDER BY d.date), 6) AS benchmark_equity
FROM base_daily d JOIN bm_daily b ON b.date = d.date
""")
def equity_curve(spark, folder):
    market = Market(spark, folder)
    index = index_returns(market).select("date", F.col("ret").alias("benchmark_return"))
    rows = daily_of(market, BASELINE).join(index, "date")
    mine = rs.running_equity(rows, ["config"], "ret").withColumnRenamed("equity", "strategy_equity").drop("drawdown")
    both = rs.running_equity(mine, ["config"], "benchmark_return").withColumnRenamed("equity", "benchmark_equity")
    return both.select("date", F.round("ret", 8).alias("strategy_return"), F.round("benchmark_return", 8).alias("benchmark_return"),
                       F.round("turnover", 8).alias("turnover"), F.col("holdings").alias("positions"),
                       F.round("cash_weight", 8).alias("cash_weight"), F.round("strategy_equity", 6).alias("strategy_equity"),
                       F.round("benchmark_equity", 6).alias("benchmark_equity"))


def sql_cut(source: str) -> str:
    return f"SELECT d.*, k.cutoff FROM {source} d JOIN (SELECT unnest({CUTOFFS}) AS cutoff) k ON k.cutoff > year(d.date)"


view("obj", f"""
SELECT t.*, CASE WHEN t.annual_turnover > {rs.MAX_TURNOVER} OR t.average_positions < {rs.MIN_POSITIONS} THEN -100 - t.annual_turnover ELSE
       0.45 * s_mean + 0.25 * s_min + 2 * a_mean + a_min + 0.5 * (t.cagr - b.cagr) - 0.5 * abs(dd) - 0.02 * t.annual_turnover END AS objective
FROM ({sql_metrics(sql_cut('sw_daily'), 'config, cutoff', False)}) t
JOIN ({sql_metrics(sql_cut('bm_daily'), 'cutoff', False)}) b ON b.cutoff = t.cutoff
JOIN (SELECT f.config, k.cutoff, avg(f.sharpe) AS s_mean, min(f.sharpe) AS s_min, avg(f.cagr - g.cagr) AS a_mean, min(f.cagr - g.cagr) AS a_min,
             min(f.maximum_drawdown) AS dd
      FROM ({sql_metrics('SELECT *, year(date) AS y FROM sw_daily', 'config, y', False)}) f
      JOIN ({sql_metrics('SELECT *, year(date) AS y FROM bm_daily', 'y', False)}) g ON g.y = f.y
      JOIN (SELECT unnest({CUTOFFS}) AS cutoff) k ON k.cutoff > f.y WHERE f.sessions >= 100 GROUP BY ALL) q ON q.config = t.config AND q.cutoff = t.cutoff
WHERE t.sessions >= 252
""")
view("obj_rank", "SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY round(objective, 6) DESC, config) AS rank FROM obj")


def _neighbour_sql(i: int, name: str, step: float) -> str:
    low, high = rs.LIMITS.get(name, ("-1e300", "1e300"))
    kind = "BIGINT" if name == "max_positions" else "DOUBLE"
    return (f"SELECT * REPLACE (CAST({1000 + i} AS BIGINT) AS config, config AS parent, '{name}{step:+}' AS name, "
            f"CAST(least({high}, greatest({low}, {name} + {step}::DOUBLE)) AS {kind}) AS {name}) "
            "FROM sw_cfg WHERE config = (SELECT config FROM obj_rank WHERE cutoff = 2001 AND rank = 1)")


_register_sweep("win", " UNION ALL ".join(_neighbour_sql(i, n, step) for i, (n, step) in enumerate(rs.NEIGHBOUR_STEPS)))


def objective_of(market: Market, daily: DataFrame) -> DataFrame:
    return rs.objective(daily, index_returns(market), CUTOFFS)


@query("training_objective", "SELECT config, round(objective, 6) AS objective FROM obj WHERE cutoff = 2001")
def training_objective(spark, folder):
    market = Market(spark, folder)
    return objective_of(market, daily_of(market, GRID)).filter("cutoff = 2001").select("config", F.round("objective", 6).alias("objective"))


@query("rank_prefix", "SELECT cutoff, config, rank, round(objective, 6) AS objective FROM obj_rank")
def rank_prefix(spark, folder):
    market = Market(spark, folder)
    return rs.ranked(objective_of(market, daily_of(market, GRID))).select(
        F.col("cutoff").cast("long").alias("cutoff"), "config", "rank", F.round("objective", 6).alias("objective"))


view("wf", f"""
SELECT c.cutoff, c.config, y.cagr, y.sharpe, y.maximum_drawdown, b.sharpe AS baseline_sharpe
FROM obj_rank c JOIN ({sql_metrics('SELECT *, year(date) AS y FROM sw_daily', 'config, y', False)}) y ON y.config = c.config AND y.y = c.cutoff
JOIN ({sql_metrics('SELECT *, year(date) AS y FROM sw_daily', 'config, y', False)}) b ON b.config = 0 AND b.y = c.cutoff WHERE c.rank = 1
""")


def walk_forward_rows(market: Market, daily: DataFrame) -> DataFrame:
    """For each test year the configuration that was best before it, evaluated on that year."""
    best = rs.ranked(objective_of(market, daily)).filter("rank = 1").select("cutoff", "config")
    yearly = rs.metrics(daily.withColumn("cutoff", F.year("date")), ["config", "cutoff"], strict=False)
    base = yearly.filter("config = 0").select("cutoff", F.col("sharpe").alias("baseline_sharpe"))
    return best.join(yearly, ["config", "cutoff"]).join(base, "cutoff")


@query("walk_forward", "SELECT cutoff AS test_year, config, round(cagr, 6) AS cagr, round(sharpe, 6) AS sharpe, round(maximum_drawdown, 6) AS maximum_drawdown, round(baseline_sharpe, 6) AS baseline_sharpe FROM wf")
def walk_forward(spark, folder):
    market = Market(spark, folder)
    return walk_forward_rows(market, daily_of(market, GRID)).select(
        F.col("cutoff").cast("long").alias("test_year"), "config",
        *[F.round(x, 6).alias(x) for x in ("cagr", "sharpe", "maximum_drawdown", "baseline_sharpe")])


@query("ablation_select", f"""
SELECT m.config, c.name, round(m.sharpe, 6) AS sharpe, round(m.maximum_drawdown, 6) AS maximum_drawdown, eligible,
       row_number() OVER (ORDER BY eligible DESC, round(m.sharpe, 6) DESC NULLS LAST, round(m.maximum_drawdown, 6) DESC, m.config) AS rank
FROM (SELECT *, coalesce(sharpe IS NOT NULL AND average_positions >= {rs.MIN_POSITIONS}, false) AS eligible
      FROM ({sql_metrics("SELECT * FROM abl_daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", 'config')})) m JOIN abl_cfg c ON c.config = m.config
""")
def ablation_select(spark, folder):
    """Variants by training Sharpe, then drawdown; the baseline wins exact ties."""
    daily = daily_of(Market(spark, folder), ABLATIONS).filter("date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
    rows = rs.metrics(daily, ["config"]).withColumn(
        "eligible", F.col("sharpe").isNotNull() & (F.col("average_positions") >= rs.MIN_POSITIONS))
    names = spark.createDataFrame([(c["config"], c["name"]) for c in ABLATIONS], "config long, name string")
    order = Window.orderBy(F.col("eligible").desc(), F.round("sharpe", 6).desc_nulls_last(), F.round("maximum_drawdown", 6).desc(), "config")
    return rows.join(names, "config").select("config", "name", F.round("sharpe", 6).alias("sharpe"),
                                             F.round("maximum_drawdown", 6).alias("maximum_drawdown"), "eligible",
                                             F.row_number().over(order).cast("long").alias("rank"))


view("scen_daily", """
SELECT 'normal' AS scenario, * FROM sw_daily UNION ALL SELECT 'double_cost', * REPLACE (ret - 0.0015::DOUBLE * turnover AS ret) FROM sw_daily UNION ALL SELECT 'fa_lag_plus90', * FROM lag_daily
""")
view("scen", sql_metrics(sql_periods("scen_daily"), "scenario, config, period", False))


def scenarios_of(market: Market, normal: DataFrame) -> DataFrame:
    """Metrics per scenario, configuration and period: normal, double cost, statements 90 days later."""
    late = daily_of(market, GRID, ON_FIXTURES.reporting_lag_days + 90)
    twice = rs.at_cost(normal, EXTRA_COST)
    rows = normal.withColumn("scenario", F.lit("normal")).unionByName(twice.withColumn("scenario", F.lit("double_cost"))).unionByName(
        late.withColumn("scenario", F.lit("fa_lag_plus90")))
    return rs.metrics(rs.in_periods(rows, PERIODS), ["scenario", "config", "period"], strict=False)


@query("stress_scenarios", f"SELECT scenario, config, period, sessions, {', '.join(f'round({x}, 6) AS {x}' for x in METRICS[:4])} FROM scen")
def stress_scenarios(spark, folder):
    market = Market(spark, folder)
    return scenarios_of(market, daily_of(market, GRID)).select(
        "scenario", "config", "period", "sessions", *[F.round(x, 6).alias(x) for x in METRICS[:4]])


def _wide(alias: str, scenario: str, config: str) -> str:
    return ", ".join(f"max({m}) FILTER (scenario = '{scenario}' AND config = {config} AND period = '{p}') AS {alias}_{p}_{m}"
                     for p, *_ in PERIODS for m in METRICS[:4])


GATES = """
  ('training_candidate_differs', sel <> 0),
  ('validation_cagr_not_worse', s_validation_cagr >= b_validation_cagr),
  ('validation_sharpe_not_worse', s_validation_sharpe >= b_validation_sharpe),
  ('validation_drawdown_within_2pp', s_validation_maximum_drawdown >= b_validation_maximum_drawdown - 0.02),
  ('walk_forward_majority_years_not_worse', wins >= need),
  ('neighbors_median_sharpe_above_baseline', local_sharpe >= b_train_sharpe),
  ('validation_double_cost_positive', d_validation_cagr > 0),
  ('validation_delayed_fa_positive', l_validation_cagr > 0),
  ('stress_sharpe_not_worse_by_0_25', s_stress_sharpe >= b_stress_sharpe - 0.25),
  ('stress_drawdown_within_5pp', s_stress_maximum_drawdown >= b_stress_maximum_drawdown - 0.05),
  ('full_cagr_not_worse', s_full_cagr >= b_full_cagr),
  ('full_sharpe_not_worse', s_full_sharpe >= b_full_sharpe),
  ('full_drawdown_within_2pp', s_full_maximum_drawdown >= b_full_maximum_drawdown - 0.02)
"""
_NBR_TRAIN = "SELECT d.*, c.parent FROM win_daily d JOIN win_cfg c ON c.config = d.config WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"
view("gate_row", f"""
SELECT any_value(sel) AS sel, {_wide('b', 'normal', '0')}, {_wide('s', 'normal', 'sel')}, {_wide('d', 'double_cost', 'sel')}, {_wide('l', 'fa_lag_plus90', 'sel')},
  (SELECT count(*) FILTER (sharpe >= baseline_sharpe) FROM wf) AS wins, (SELECT count(*) // 2 + 1 FROM wf) AS need,
  (SELECT median(sharpe) FROM ({sql_metrics(_NBR_TRAIN, 'config, parent', False)})) AS local_sharpe
FROM scen, (SELECT config AS sel FROM obj_rank WHERE cutoff = 2001 AND rank = 1)
""")


def _lookup(scen: DataFrame, alias: str, scenario: str, sel) -> list:
    c = F.col
    return [F.max(F.when((c("scenario") == scenario) & (c("config") == sel) & (c("period") == p), c(m))).alias(f"{alias}_{p}_{m}")
            for p, *_ in PERIODS for m in METRICS[:4]]


@query("promotion_gates", f"""
SELECT g.* FROM gate_row, LATERAL (SELECT * FROM (VALUES {GATES}) AS t("check", passed)) g
UNION ALL SELECT 'all_passed', bool_and(passed) FROM gate_row, LATERAL (SELECT * FROM (VALUES {GATES}) AS t("check", passed)) g
""")
def promotion_gates(spark, folder):
    """The thirteen checks a training winner must pass against the baseline."""
    market = Market(spark, folder)
    features = rs.with_neighbours(history(market).withColumn("fill", damped(F.col("px"))), "fill")
    known = {"effective_fa": "known_fa", "fa_eligible": "known_eligible"}  # in time; the others are of statements that come later
    later = research_history(market, ON_FIXTURES.reporting_lag_days + 90, research_history(market, features=features).withColumnsRenamed(known))
    later = stage(later, "history")
    hist = later.drop(*known).withColumnsRenamed({new: name for name, new in known.items()})
    calendar = calendar_of(market)
    normal = stage(rs.sweep(hist, calendar, GRID, fill="fill"), "daily")
    winner = stage(rs.ranked(objective_of(market, normal)).filter("cutoff = 2001 AND rank = 1").select("config"), "winner")
    chosen = winner.first()  # one configuration, whose neighbours are swept next
    chosen = GRID[chosen["config"]] if chosen else GRID[0]
    sel = F.lit(chosen["config"])
    late = stage(rs.sweep(later, calendar, GRID, fill="fill"), "late")
    twice = rs.at_cost(normal, EXTRA_COST)
    rows = normal.withColumn("scenario", F.lit("normal")).unionByName(twice.withColumn("scenario", F.lit("double_cost"))).unionByName(
        late.withColumn("scenario", F.lit("fa_lag_plus90")))
    scen = stage(rs.metrics(rs.in_periods(rows, PERIODS), ["scenario", "config", "period"], strict=False), "scenarios")
    local = rs.metrics(rs.sweep(hist, calendar, rs.neighbours(chosen, 1000), "fill").filter("date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"),
                       ["config"], strict=False).agg(F.median("sharpe"))
    wf = stage(walk_forward_rows(market, normal), "walk_forward")
    wins = wf.agg(F.count(F.when(F.col("sharpe") >= F.col("baseline_sharpe"), 1)).alias("w"), F.floor(F.count("*") / 2 + 1).alias("n"))
    row = scen.agg(*_lookup(scen, "b", "normal", F.lit(0)), *_lookup(scen, "s", "normal", sel), *_lookup(scen, "d", "double_cost", sel),
                   *_lookup(scen, "l", "fa_lag_plus90", sel))
    row = row.withColumns({"sel": sel, "local_sharpe": stage(local.toDF("m"), "local").scalar(), "wins": wins.select("w").scalar(),
                           "need": wins.select("n").scalar()})
    checks = {}
    for line in GATES.strip().splitlines():
        name, condition = line.strip().rstrip(",")[2:-1].split("', ", 1)
        checks[name] = F.expr(condition)
    return rs.check_rows(row, checks)


EXPERIMENT_GATES = {
    "train_sharpe_higher": "c_train_sharpe > b_train_sharpe",
    "validation_cagr_not_worse": "c_validation_cagr >= b_validation_cagr",
    "validation_sharpe_not_worse": "c_validation_sharpe >= b_validation_sharpe",
    "stress_cagr_not_worse": "c_stress_cagr >= b_stress_cagr",
    "stress_drawdown_not_worse": "c_stress_maximum_drawdown >= b_stress_maximum_drawdown",
    "full_cagr_higher": "c_full_cagr > b_full_cagr",
    "full_sharpe_higher": "c_full_sharpe > b_full_sharpe",
    "full_drawdown_not_worse": "c_full_maximum_drawdown >= b_full_maximum_drawdown",
    "full_turnover_not_higher": "c_full_annual_turnover <= b_full_annual_turnover",
    "double_cost_cagr_not_worse": "c_double_full_cagr >= b_double_full_cagr",
    "double_cost_stress_not_worse": "c_double_stress_cagr >= b_double_stress_cagr",
}
# Equal results may differ in the last bits of a sum, so gates compare at nine decimals.
EXPERIMENT_GATES = {n: re.sub(r"([cb]_\w+)", r"round(\1, 9)", e) for n, e in EXPERIMENT_GATES.items()}
view("exd_daily", "SELECT * REPLACE (ret - 0.0015::DOUBLE * turnover AS ret) FROM exq_daily")
view("ex_all", f"""
SELECT config, period, cagr, sharpe, maximum_drawdown, annual_turnover, false AS twice FROM ({sql_metrics(sql_periods('exq_daily'), 'config, period', False)})
UNION ALL SELECT config, period, cagr, sharpe, maximum_drawdown, annual_turnover, true FROM ({sql_metrics(sql_periods('exd_daily'), 'config, period', False)})
""")
view("ex_wide", "SELECT c.config, " + ", ".join(
    f"max(c.{m}) FILTER (c.period = '{p}' AND {'' if t else 'NOT '}c.twice) AS c_{'double_' if t else ''}{p}_{m}, "
    f"max(b.{m}) FILTER (b.period = '{p}' AND {'' if t else 'NOT '}b.twice) AS b_{'double_' if t else ''}{p}_{m}"
    for t in (False, True) for p, *_ in PERIODS for m in METRICS[:4])
    + " FROM ex_all c JOIN ex_all b ON b.config = 0 AND b.period = c.period AND b.twice = c.twice WHERE c.config > 0 GROUP BY c.config")
_EX_VALUES = ", ".join(f"('{n}', {e})" for n, e in EXPERIMENT_GATES.items())


@query("experiment_gates", f"""
SELECT config, g."check", g.passed FROM ex_wide, LATERAL (SELECT * FROM (VALUES {_EX_VALUES}) AS t("check", passed)) g
UNION ALL SELECT config, 'all_passed', bool_and(g.passed) FROM ex_wide, LATERAL (SELECT * FROM (VALUES {_EX_VALUES}) AS t("check", passed)) g GROUP BY config
""")
def experiment_gates(spark, folder):
    """The eleven checks of each experiment against the baseline."""
    market = Market(spark, folder)
    hist, calendar = stage(research_history(market), "history"), calendar_of(market)
    once = rs.sweep(hist, calendar, EXPERIMENTS, fill="fill").withColumn("twice", F.lit(False))
    once = stage(once, "experiments")
    twice = rs.at_cost(once, EXTRA_COST).withColumn("twice", F.lit(True))
    rows = stage(rs.metrics(rs.in_periods(once.unionByName(twice), PERIODS), ["config", "period", "twice"], strict=False), "experiments")
    base = rows.filter("config = 0").select("period", "twice", *[F.col(m).alias(f"b_{m}") for m in METRICS[:4]])
    both = rows.filter("config > 0").join(base, ["period", "twice"])
    wide = both.groupBy("config").agg(*[
        F.max(F.when((F.col("period") == p) & (F.col("twice") == t), F.col(f"b_{m}" if side == "b" else m))).alias(
            f"{side}_{'double_' if t else ''}{p}_{m}")
        for side in ("b", "c") for t in (False, True) for p, *_ in PERIODS for m in METRICS[:4]])
    return rs.check_rows(wide, {n: F.expr(e) for n, e in EXPERIMENT_GATES.items()}, ["config"])
