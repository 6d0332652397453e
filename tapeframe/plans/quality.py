"""Quality, coverage, pipeline-status and serving queries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.operators import clean, prices as px, quality as q, serving as sv
from tapeframe.operators.ranking import global_row_number
from tapeframe.plans.fundamentals import peer_medians, snapshot
from tapeframe.plans.ledger import board
from tapeframe.plans.portfolio import SLOTS, assigned_of
from tapeframe.plans.prices import CRITICAL_ITEMS, NUM, RUN_ID, generations, quarterly
from tapeframe.plans.registry import query, rounded, view
from tapeframe.plans.signals import signals
from tapeframe.runtime import stage
from tapeframe.sources import landed as L
from tapeframe.sources.driver import Market
from tapeframe.sources.store import Store


def cleaned(market: Market) -> DataFrame:
    return clean.prices(L.prices(market.bars))


def annual(market: Market) -> DataFrame:
    return clean.financials(L.financials(market.fin_wide), "annual")


class Serving:
    """The published tables that lookups by ticker read."""

    def __init__(self, spark, folder):
        self.market = Market(spark, folder)
        self.store = Store(spark, folder, ["lineitem", "part", "supplier", "nation", "region"])

    def bars(self):
        return self.store.table("bars", lambda: self.market.bars, "date")

    def prices(self):
        """Bars that are ready for analysis."""
        return self.store.table("prices", lambda: clean.best_price_rows(clean.typed_prices(L.prices(self.market.bars))), "date",
                                finish=lambda rows: clean.checked_prices(rows).filter("analysis_ready"))

    def financials(self):
        return self.store.table("financials", lambda: annual(self.market).filter("row_valid"), "period_end")

    def actions(self):
        return self.store.table("actions", lambda: self.market.actions, "ex_date")

    def snapshots(self):
        return self.store.table("snapshots", lambda: snapshot(self.market), "as_of_utc")

    def peers(self):
        return self.store.table("peers", lambda: peer_medians(self.market), "ticker")

    def signals(self):
        return self.store.table("signals", lambda: signals(self.market), "signal_date")


@query("quality_report", """
SELECT 'companies' AS dataset, 'rows' AS "check", count(*) AS value FROM fx_companies
UNION ALL SELECT 'companies', 'missing_market_cap', count(*) FILTER (market_cap IS NULL) FROM fx_companies
UNION ALL SELECT 'financial_annual', 'rows', count(*) FROM cl_fin
UNION ALL SELECT 'financial_annual', 'missing_published_date', count(*) FILTER (published_date IS NULL) FROM cl_fin
UNION ALL SELECT 'financial_annual', 'duplicates_removed', (SELECT count(*) FROM ld_fin) - count(*) FROM cl_fin
UNION ALL SELECT 'price_daily', 'rows', count(*) FROM cl_prices
UNION ALL SELECT 'price_daily', 'invalid_ohlc_rows', count(*) FILTER (NOT ohlc_valid) FROM cl_prices
UNION ALL SELECT 'price_daily', 'invalid_volume_rows', count(*) FILTER (NOT volume_valid) FROM cl_prices
UNION ALL SELECT 'price_daily', 'duplicates_removed', (SELECT count(*) FROM ld_prices) - count(*) FROM cl_prices
UNION ALL SELECT 'corporate_actions', 'rows', count(*) FROM fx_actions
""")
def quality_report(spark, folder):
    market = Market(spark, folder)
    landed = {"fin": L.financials(market.fin_wide), "px": L.prices(market.staged_bars)}
    total = lambda name: landed[name].agg(F.count("*")).scalar()
    rows = F.count("*")
    return q.union_all([
        q.as_rows(market.companies, "companies", {"rows": rows, "missing_market_cap": q.count_if(F.col("market_cap").isNull())}),
        q.as_rows(clean.financials(landed["fin"], "annual"), "financial_annual", {
            "rows": rows, "missing_published_date": q.count_if(F.col("published_date").isNull()), "duplicates_removed": total("fin") - rows}),
        q.as_rows(clean.prices(landed["px"]), "price_daily", {
            "rows": rows, "invalid_ohlc_rows": q.count_if(~F.col("ohlc_valid")), "invalid_volume_rows": q.count_if(~F.col("volume_valid")),
            "duplicates_removed": total("px") - rows}),
        q.as_rows(market.actions, "corporate_actions", {"rows": rows})])


_CRIT = "[" + ", ".join(repr(n) for n in CRITICAL_ITEMS) + "]"
view("fin_stats", f"""
SELECT ticker, count(DISTINCT report_period) AS periods, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       round(sum(nulls) / sum(n) * 100 + 1e-9, 2) AS missing_percent, round(sum(undated) / sum(n) * 100 + 1e-9, 2) AS undated_percent,
       list_sort(list_filter({_CRIT}, lambda x: NOT list_contains(list(DISTINCT item_code), x))) AS missing
FROM (SELECT ticker, statement, report_period, item_code, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls,
             count(*) FILTER (published_date IS NULL) AS undated FROM ld_fin GROUP BY ALL) GROUP BY ticker
""")


@query("financial_stats", "SELECT ticker, periods, duplicate_rows, missing_percent, undated_percent, array_to_string(missing, ',') AS missing_critical FROM fin_stats")
def financial_stats(spark, folder):
    return q.financial_stats(L.financials(Market(spark, folder).fin_wide), CRITICAL_ITEMS).drop("missing_count")


@query("price_stats", """
SELECT ticker, count(*) AS sessions, min(date) AS first_date, max(date) AS last_date,
       round(avg((volume IS NULL)::INT) / 5 * 100 + 1e-9, 2) AS missing_percent, count(*) - count(DISTINCT date) AS duplicate_rows FROM ld_typed GROUP BY ticker
""")
def price_stats(spark, folder):
    return q.price_stats(clean.typed_prices(L.prices(Market(spark, folder).bars)))


@query("dataset_status", """
SELECT c.ticker, CASE WHEN f.ticker IS NULL THEN 'MISSING' WHEN len(f.missing) <= 2 THEN 'OK' ELSE 'PARTIAL' END AS annual_status,
       CASE WHEN p.ticker IS NULL THEN 'MISSING' ELSE 'OK' END AS price_status
FROM fx_companies c LEFT JOIN fin_stats f ON f.ticker = c.ticker LEFT JOIN (SELECT DISTINCT ticker FROM fx_bars) p ON p.ticker = c.ticker
""")
def dataset_status(spark, folder):
    market = Market(spark, folder)
    stats = q.financial_stats(L.financials(market.fin_wide), CRITICAL_ITEMS).select("ticker", "missing_count")
    traded = market.bars.select("ticker").distinct().withColumn("traded", F.lit(True))
    out = market.companies.select("ticker").join(stats, "ticker", "left").join(traded, "ticker", "left")
    return out.select("ticker", q.dataset_status(F.col("missing_count").isNotNull(), F.col("missing_count"), 2).alias("annual_status"),
                      q.dataset_status(F.coalesce("traded", F.lit(False)), F.lit(0)).alias("price_status"))


_KINDS = ["cash_dividend", "stock_dividend", "bonus_shares", "stock_split", "rights_issue", "capital_increase"]


@query("coverage_report", f"""
SELECT t.ticker, concat('fa_annual.', i.item) AS variable, f.n IS NOT NULL AS available, coalesce(f.sources, '') AS source, coalesce(f.periods, 0) AS periods_available
FROM fx_companies t CROSS JOIN (SELECT unnest({_CRIT}) AS item) i LEFT JOIN (
  SELECT ticker, item_code, count(*) AS n, count(DISTINCT report_period) AS periods, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources FROM ld_fin GROUP BY ALL) f
  ON f.ticker = t.ticker AND f.item_code = i.item
UNION ALL SELECT t.ticker, concat('corporate_actions.', k.kind), a.n IS NOT NULL, CASE WHEN a.n IS NULL THEN '' ELSE 'vnstock KBS' END, coalesce(a.n, 0)
FROM fx_companies t CROSS JOIN (SELECT unnest({_KINDS}) AS kind) k LEFT JOIN (SELECT ticker, action_type, count(*) AS n FROM fx_actions GROUP BY ALL) a
  ON a.ticker = t.ticker AND a.action_type = k.kind
UNION ALL SELECT t.ticker, 'ta_daily.close', p.n IS NOT NULL, coalesce(p.s, ''), coalesce(p.n, 0) FROM fx_companies t LEFT JOIN (
  SELECT ticker, count(close) AS n, string_agg(DISTINCT source, ' | ' ORDER BY source) AS s FROM ld_typed GROUP BY ticker) p ON p.ticker = t.ticker
UNION ALL SELECT ticker, 'metadata.market_cap', market_cap IS NOT NULL, 'combined metadata', (market_cap IS NOT NULL)::INT FROM fx_companies
""")
def coverage_report(spark, folder):
    """Availability of every required variable per ticker; sources are few per variable."""
    market = Market(spark, folder)
    tickers = market.companies.select("ticker")

    def spread(names, prefix):
        return tickers.select("ticker", F.explode(F.array(*[F.lit(n) for n in names])).alias("name")).withColumn(
            "variable", F.concat(F.lit(prefix + "."), F.col("name")))

    def report(rows, have):
        out = rows.join(have, [n for n in ("ticker", "name") if n in rows.columns and n in have.columns], "left")
        return out.select("ticker", "variable", F.col("n").isNotNull().alias("available"), F.coalesce("sources", F.lit("")).alias("source"),
                          F.coalesce("n", F.lit(0)).alias("periods_available"))

    sources = F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources")
    items = L.financials(market.fin_wide).groupBy("ticker", F.col("item_code").alias("name")).agg(F.count_distinct("report_period").alias("n"), sources)
    kinds = market.actions.withColumn("source", F.lit("vnstock KBS")).groupBy("ticker", F.col("action_type").alias("name")).agg(F.count("*").alias("n"), sources)
    closes = clean.typed_prices(L.prices(market.bars)).groupBy("ticker").agg(F.count("close").alias("n"), sources)
    known = F.col("market_cap").isNotNull()
    return q.union_all([
        report(spread(CRITICAL_ITEMS, "fa_annual"), items), report(spread(_KINDS, "corporate_actions"), kinds),
        report(tickers.withColumn("variable", F.lit("ta_daily.close")), closes),
        market.companies.select("ticker", F.lit("metadata.market_cap").alias("variable"), known.alias("available"),
                                F.lit("combined metadata").alias("source"), known.cast("long").alias("periods_available"))])


@query("summary_actions", "SELECT final_action, count(*) AS rows FROM fx_signals GROUP BY final_action")
def summary_actions(spark, folder):
    return signals(Market(spark, folder)).groupBy("final_action").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"))


_COVERAGE = """SELECT count(*) AS total, count(*) FILTER (fa_status = 'READY') AS fa_ready, count(*) FILTER (fa_pass) AS fa_pass,
       count(*) FILTER (ta_status = 'READY') AS ta_ready, max(signal_date) AS signal_date FROM fx_signals"""


def coverage_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), q.count_if(F.col("fa_status") == "READY").alias("fa_ready"),
                    q.count_if(F.col("fa_pass")).alias("fa_pass"), q.count_if(F.col("ta_status") == "READY").alias("ta_ready"),
                    F.max("signal_date").alias("signal_date"))


@query("summary_coverage", _COVERAGE)
def summary_coverage(spark, folder):
    return coverage_counts(signals(Market(spark, folder)))


@query("status_breakdown", """
SELECT 'fa' AS layer, fa_status AS status, coalesce(nullif(hard_reject_reason, ''), 'none') AS reason, count(*) AS rows FROM fx_signals GROUP BY ALL
UNION ALL SELECT 'ta', ta_status, coalesce(nullif(missing_data_reason, ''), 'none'), count(*) FROM fx_signals GROUP BY ALL
""")
def status_breakdown(spark, folder):
    rows = stage(signals(Market(spark, folder)), "signals")
    return breakdowns(rows)


def breakdowns(rows: DataFrame) -> DataFrame:
    tag = lambda layer, frame: frame.select(F.lit(layer).alias("layer"), "status", "reason", "rows")
    return tag("fa", sv.breakdown(rows, "fa_status", "hard_reject_reason")).unionByName(
        tag("ta", sv.breakdown(rows, "ta_status", "missing_data_reason")))


@query("watch_breakdown", "SELECT watch_reason, count(*) AS rows FROM fx_signals WHERE final_action = 'WATCH' GROUP BY watch_reason")
def watch_breakdown(spark, folder):
    return signals(Market(spark, folder)).filter("final_action = 'WATCH'").groupBy("watch_reason").agg(F.count("*").alias("rows"))


_PROFILE = "SELECT source, count(*) AS rows, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date FROM cl_prices GROUP BY source"


@query("source_profile", _PROFILE)
def source_profile(spark, folder):
    return profile(cleaned(Market(spark, folder)))


def profile(rows: DataFrame) -> DataFrame:
    """Per source; (source, ticker) is reduced first, so one source with most rows is spread over tasks."""
    inner = rows.groupBy("source", "ticker").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    return inner.groupBy("source").agg(F.sum("n").alias("rows"), F.count("*").alias("tickers"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))


_SCALARS = """
SELECT count(*) AS price_rows, count(*) FILTER (analysis_ready) AS analysis_ready_rows, count(*) FILTER (NOT analysis_ready) AS rejected_price_rows,
       (SELECT count(*) FROM fx_benchmark) AS benchmark_rows, (SELECT count(*) FROM cl_fin) AS annual_financial_rows,
       (SELECT count(*) FROM cl_fin_q) AS quarterly_financial_rows, (SELECT count(*) FROM fx_snapshot) AS snapshot_rows,
       min(date) AS first_market_date, max(date) FILTER (analysis_ready) AS latest_market_date FROM cl_prices
"""


def scalars(market: Market) -> DataFrame:
    count = lambda rows: rows.agg(F.count("*")).scalar()
    years = annual(market)
    out = cleaned(market).agg(
        F.count("*").alias("price_rows"), q.count_if(F.col("analysis_ready")).alias("analysis_ready_rows"),
        q.count_if(~F.col("analysis_ready")).alias("rejected_price_rows"), F.min("date").alias("first_market_date"),
        F.max(F.when(F.col("analysis_ready"), F.col("date"))).alias("latest_market_date"))
    return out.withColumns({"benchmark_rows": count(market.staged_benchmark), "annual_financial_rows": count(years),
                            "quarterly_financial_rows": count(quarterly(years)), "snapshot_rows": count(snapshot(market))})


@query("quality_scalars", _SCALARS)
def quality_scalars(spark, folder):
    return scalars(Market(spark, folder))


@query("latest_period_items", """
SELECT f.ticker, f.period_end, f.item_code, f.value FROM cl_fin f JOIN (SELECT ticker, max(period_end) AS p FROM cl_fin GROUP BY ticker) m ON m.ticker = f.ticker AND f.period_end = m.p
""")
def latest_period_items(spark, folder):
    rows = sv.latest_period_items(annual(Market(spark, folder)))
    return rows.select("ticker", "period_end", F.explode("items").alias("item_code", "value"))


@query("latest_n_per_ticker", """
SELECT 'price' AS kind, ticker, date AS at FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fx_bars) WHERE rn <= 2
UNION ALL SELECT 'action', ticker, ex_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ex_date DESC) AS rn FROM fx_actions) WHERE rn <= 5
""")
def latest_n_per_ticker(spark, folder):
    serving = Serving(spark, folder)
    bars = sv.per_ticker_newest(serving.bars().newest(None, 2), "date", 2).select(F.lit("price").alias("kind"), "ticker", F.col("date").alias("at"))
    acts = sv.per_ticker_newest(serving.actions().newest(None, 5), "ex_date", 5).select(F.lit("action").alias("kind"), "ticker", F.col("ex_date").alias("at"))
    return bars.unionByName(acts)


@query("review_list", "SELECT ticker, sessions, signal_date, missing_data_reason, fa_status, final_action FROM fx_signals WHERE NOT ta_ready OR NOT price_fresh")
def review_list(spark, folder):
    """Signals that need a look at the data, thinnest history first."""
    rows = signals(Market(spark, folder)).filter(~F.col("ta_ready") | ~F.col("price_fresh"))
    return rows.select("ticker", "sessions", "signal_date", "missing_data_reason", "fa_status", "final_action").orderBy("sessions", "ticker")


AUDIT_SIZE, AUDIT_DAY = 7, 730684


@query("rotating_audit", f"""
SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM fx_companies)
WHERE (i - ({AUDIT_DAY} * least({AUDIT_SIZE}, n)) % n + n) % n < least({AUDIT_SIZE}, n)
""")
def rotating_audit(spark, folder):
    """The day's circular slice of the sorted universe."""
    return audit_slice(Market(spark, folder).companies.select("ticker"), AUDIT_SIZE, AUDIT_DAY)


def audit_slice(universe: DataFrame, size: int, day: int) -> DataFrame:
    ranked = global_row_number(universe.distinct(), [F.col("ticker").asc()], "i")
    n = ranked.agg(F.count("*")).scalar()
    width = F.least(F.lit(size), n)
    return ranked.filter(F.pmod(F.col("i") - 1 - (day * width) % n, n) < width).select("ticker")


view("audit_set", f"""
SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM fx_companies)
WHERE (i - ({AUDIT_DAY} * least({AUDIT_SIZE}, n)) % n + n) % n < least({AUDIT_SIZE}, n)
""")


_RESTATED = "old_source_checksum IS NOT NULL AND new_source_checksum IS NOT NULL AND old_source_checksum <> new_source_checksum"


@query("refetch_reasons", f"""
SELECT ticker, reason, reason IS NULL AND restated AS held_back FROM (
  SELECT c.ticker, r.ticker IS NOT NULL AS restated, CASE WHEN {NUM.replace('ticker', 'c.ticker')} % 11 = 0 THEN 'corporate_action_changed'
         WHEN a.ticker IS NOT NULL THEN 'scheduled_history_audit' WHEN r.missing = 0 THEN 'confirmed_source_restatement' END AS reason
  FROM fx_companies c LEFT JOIN audit_set a ON a.ticker = c.ticker LEFT JOIN (
    SELECT e.ticker, count(*) FILTER (s.ticker IS NULL) AS missing FROM (SELECT * FROM revs WHERE {_RESTATED}) e
    LEFT JOIN (SELECT * FROM gen_new WHERE {NUM} % 4 <> 0) s ON s.ticker = e.ticker AND s.date = e.date AND s.source_checksum = e.new_source_checksum
    GROUP BY e.ticker) r ON r.ticker = c.ticker)
""")
def refetch_reasons(spark, folder):
    """Why a ticker's whole history is fetched again: changed actions, the audit's turn, or a restatement that a second
    fetch reproduced in full.  One that it did not (here it lost every fourth ticker) is held back."""
    market, old, new = generations(spark, folder)
    actions = market.actions.select("ticker", "ex_date", "action_type")
    later = actions.withColumn("ex_date", F.when(F.expr(L.NUMBER) % 11 == 0, F.date_add("ex_date", 1)).otherwise(F.col("ex_date")))
    before = clean.action_fingerprints(actions)
    after = clean.action_fingerprints(later).withColumnRenamed("fingerprint", "now")
    changed = before.join(after, "ticker").filter("fingerprint <> now").select("ticker", F.lit(True).alias("changed"))
    audit = audit_slice(market.companies.select("ticker"), AUDIT_SIZE, AUDIT_DAY).withColumn("audit", F.lit(True))
    restated = stage(px.source_restatements(px.revisions(old, new, RUN_ID, "overlap")).select(*px.KEY, "new_source_checksum"), "restated")
    second = px.source_restatements(px.revisions(old, new.filter(F.expr(L.NUMBER) % 4 != 0), RUN_ID, "overlap"))
    open_ = px.unconfirmed(restated, second).select("ticker").distinct().withColumn("open", F.lit(True))
    return q.refetch_reasons(market.companies.select("ticker"), changed, audit, restated.select("ticker").distinct().withColumn("restated", F.lit(True)), open_)


@query("sync_run_summary", f"""
SELECT '{RUN_ID}' AS sync_run_id, count(*) AS requested_tickers, count(*) FILTER (n > 0) AS updated_tickers, count(*) FILTER (n IS NULL) AS failed_tickers,
       CAST((SELECT count(*) FROM revs) AS BIGINT) AS revision_rows,
       CASE WHEN count(*) FILTER (n IS NULL) * 1.0 / count(*) > 0.1 THEN 'failed' WHEN count(*) FILTER (n IS NULL) > 0 THEN 'degraded' ELSE 'success' END AS status
FROM (SELECT c.ticker, x.n FROM fx_companies c LEFT JOIN (SELECT ticker, count(*) AS n FROM gen_new WHERE {NUM} % 25 <> 3 GROUP BY ticker) x ON x.ticker = c.ticker)
""")
def sync_run_summary(spark, folder):
    market, old, new = generations(spark, folder)
    got = new.filter(F.expr(L.NUMBER) % 25 != 3).groupBy("ticker").agg(F.count("*").alias("n"))
    changes = px.revisions(old, new, RUN_ID, "overlap").agg(F.count("*")).scalar()
    failed = q.count_if(F.col("n").isNull())
    out = market.companies.select("ticker").join(got, "ticker", "left").agg(
        F.count("*").alias("requested_tickers"), F.count("n").alias("updated_tickers"), failed.alias("failed_tickers"))
    share = F.col("failed_tickers") / F.col("requested_tickers")
    return out.select(F.lit(RUN_ID).alias("sync_run_id"), "requested_tickers", "updated_tickers", "failed_tickers", changes.alias("revision_rows"),
                      F.when(share > 0.1, "failed").when(F.col("failed_tickers") > 0, "degraded").otherwise("success").alias("status"))


@query("rebuild_guard", """
SELECT count(*) AS expected, count(p.ticker) AS completed, CASE WHEN count(p.ticker) < count(*) THEN concat('raw mirror incomplete (', count(p.ticker), '/', count(*), ')') END AS deferred_reason
FROM fx_companies c LEFT JOIN (SELECT DISTINCT ticker FROM fx_fin_wide WHERE fiscal_year = 1999) p ON p.ticker = c.ticker
""")
def rebuild_guard(spark, folder):
    """A rebuild waits while fewer tickers are complete than the published table has."""
    market = Market(spark, folder)
    done = market.fin_wide.filter("fiscal_year = 1999").select("ticker", F.lit(1).alias("done")).distinct()
    out = market.companies.select("ticker").join(done, "ticker", "left").agg(F.count("*").alias("expected"), F.count("done").alias("completed"))
    text = F.concat(F.lit("raw mirror incomplete ("), F.col("completed").cast("string"), F.lit("/"), F.col("expected").cast("string"), F.lit(")"))
    return out.select("expected", "completed", F.when(F.col("completed") < F.col("expected"), text).alias("deferred_reason"))


NOW = "2001-11-06 12:00:00"


@query("freshness_status", f"""
SELECT ticker, date_diff('hour', CAST(date AS TIMESTAMP), TIMESTAMP '{NOW}') AS age_hours, date_diff('hour', CAST(date AS TIMESTAMP), TIMESTAMP '{NOW}') <= 72 AS data_fresh FROM fx_last_bar
""")
def freshness_status(spark, folder):
    """Age of each ticker's last completed load at a given time, and whether it is within 72 hours."""
    last = Market(spark, folder).bars.groupBy("ticker").agg(F.max("date").alias("date"))
    age = ((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("date").cast("timestamp"))) / 3600).cast("long")
    return last.select("ticker", age.alias("age_hours"), (age <= 72).alias("data_fresh"))


@query("sync_consistency", """
SELECT (SELECT count(*) FROM fx_signals) AS signals, (SELECT count(*) FROM fx_companies) AS companies, (SELECT max(signal_date) FROM fx_signals) AS signal_date,
       (SELECT max(date) FROM fx_benchmark WHERE date <= DATE '2001-07-16') AS benchmark_date,
       (SELECT max(date) FROM fx_bars WHERE date <= DATE '2001-07-16') AS price_date,
       (SELECT count(*) FROM fx_signals) = (SELECT count(*) FROM fx_companies) AND (SELECT max(signal_date) FROM fx_signals) = (SELECT max(date) FROM fx_bars WHERE date <= DATE '2001-07-16')
         AND (SELECT max(date) FROM fx_benchmark WHERE date <= DATE '2001-07-16') >= (SELECT max(date) FROM fx_bars WHERE date <= DATE '2001-07-16') AS consistent
""")
def sync_consistency(spark, folder):
    market = Market(spark, folder)
    out = signals(market).agg(F.count("*").alias("signals"), F.max("signal_date").alias("signal_date"))
    companies = market.companies.agg(F.count("*")).scalar()
    index = market.staged_benchmark.filter("date <= DATE '2001-07-16'").agg(F.max("date")).scalar()
    prices = market.staged_bars.filter("date <= DATE '2001-07-16'").agg(F.max("date")).scalar()
    return out.withColumns({"companies": companies, "benchmark_date": index, "price_date": prices}).withColumn(
        "consistent", (F.col("signals") == F.col("companies")) & (F.col("signal_date") == F.col("price_date"))
        & (F.col("benchmark_date") >= F.col("price_date")))


@query("validate_layer", """
SELECT "check", value, value BETWEEN low AND high AS passed FROM (
  SELECT 'duplicate_price_keys' AS "check", (SELECT count(*) FROM (SELECT 1 FROM cl_prices GROUP BY ticker, date HAVING count(*) > 1)) AS value, 0 AS low, 0 AS high
  UNION ALL SELECT 'source_rows_missing_checksum', (SELECT count(*) FROM cl_prices WHERE source = 'DNSE' AND (source_checksum IS NULL OR source_checksum = '')), 0, 0
  UNION ALL SELECT 'ready_missing_adjusted_close', (SELECT count(*) FROM cl_prices p LEFT JOIN bar_factors f ON f.ticker = p.ticker AND f.date = p.date
                                                    WHERE p.analysis_ready AND p.close * f.factor IS NULL), 0, 0
  UNION ALL SELECT 'actions_missing_ex_date', (SELECT count(*) FROM fx_actions WHERE ex_date IS NULL), 0, 0
  UNION ALL SELECT 'companies_minus_signals', abs((SELECT count(*) FROM fx_companies) - (SELECT count(*) FROM st_actions)), 0, 0
  UNION ALL SELECT 'stale_buys', (SELECT count(*) FROM st_actions WHERE action = 'BUY' AND NOT price_fresh), 0, 0
  UNION ALL SELECT 'hard_rejected_buys', (SELECT count(*) FROM st_actions WHERE action = 'BUY' AND rejected), 0, 0
  UNION ALL SELECT 'watch_without_reason', (SELECT count(*) FROM st_actions WHERE action = 'WATCH' AND (reason IS NULL OR reason = 'NONE')), 0, 0
  UNION ALL SELECT 'model_positions', (SELECT count(*) FROM st_after WHERE entry_date IS NOT NULL), 0, 30
  UNION ALL SELECT 'model_runs', (SELECT count(DISTINCT signal_date) FROM st_actions), 1, 1000000
  UNION ALL SELECT 'exit_without_position', (SELECT count(*) FROM st_actions WHERE action = 'EXIT' AND NOT held), 0, 0
  UNION ALL SELECT 'buy_already_held', (SELECT count(*) FROM st_actions WHERE action = 'BUY' AND held), 0, 0
  UNION ALL SELECT 'backtest_stale', (SELECT (SELECT max(date) FROM fx_benchmark) < max(date) FILTER (analysis_ready) FROM cl_prices)::INT, 0, 0)
""")
def validate_layer(spark, folder):
    """Every assertion about the published tables as one row.

    Prices, signals, state, actions, companies and the index are each read once: prices get their adjusted close and
    are grouped by key along the one order by ticker, and all their checks come from that.
    """
    market = Market(spark, folder)
    rows, state = assigned_of(market)
    actions = stage(market.actions, "actions")
    adjusted = px.adjust_prices(cleaned(market).select("ticker", "date", "close", "source", "source_checksum", "analysis_ready"), actions)
    ready = F.col("analysis_ready")
    keys = adjusted.groupBy("ticker", "date").agg(
        F.count("*").alias("n"), q.count_if((F.col("source") == "DNSE") & (F.coalesce("source_checksum", F.lit("")) == "")).alias("unmarked"),
        q.count_if(ready & F.col("adjusted_close").isNull()).alias("unadjusted"), F.bool_or(ready).alias("ready"))
    prices = keys.agg(q.count_if(F.col("n") > 1).alias("duplicate_price_keys"), F.sum("unmarked").alias("source_rows_missing_checksum"),
                      F.sum("unadjusted").alias("ready_missing_adjusted_close"), F.max(F.when(F.col("ready"), F.col("date"))).alias("latest"))
    action = F.col("final_action")
    acted = rows.agg(
        F.count("*").alias("signals"), q.count_if((action == "BUY") & ~F.col("price_fresh")).alias("stale_buys"),
        q.count_if((action == "BUY") & F.col("rejected")).alias("hard_rejected_buys"),
        q.count_if((action == "WATCH") & F.coalesce(F.col("watch_reason") == "NONE", F.lit(True))).alias("watch_without_reason"),
        q.count_if((action == "EXIT") & ~F.col("is_held")).alias("exit_without_position"),
        q.count_if((action == "BUY") & F.col("is_held")).alias("buy_already_held"), F.count_distinct("signal_date").alias("model_runs"))
    one = prices.crossJoin(acted).withColumns({  # one row each
        "actions_missing_ex_date": actions.agg(q.count_if(F.col("ex_date").isNull())).scalar(),
        "companies": market.companies.agg(F.count("*")).scalar(),
        "model_positions": state.agg(F.count("position")).scalar(), "evaluated": market.staged_benchmark.agg(F.max("date")).scalar()})
    one = one.withColumns({"companies_minus_signals": F.abs(F.col("companies") - F.col("signals")),
                           "backtest_stale": F.coalesce(F.col("evaluated") < F.col("latest"), F.col("latest").isNotNull()).cast("int")})
    bounds = {"model_positions": (0, SLOTS.max_positions), "model_runs": (1, 1_000_000)}
    names = ["duplicate_price_keys", "source_rows_missing_checksum", "ready_missing_adjusted_close", "actions_missing_ex_date", "companies_minus_signals", "stale_buys",
             "hard_rejected_buys", "watch_without_reason", "model_positions", "model_runs", "exit_without_position", "buy_already_held", "backtest_stale"]
    checks = F.array(*[q.assertion(n, F.coalesce(F.col(n), F.lit(0)), *bounds.get(n, (0, 0))) for n in names])
    return one.select(F.explode(checks).alias("x")).select("x.*")


# --- serving ---------------------------------------------------------------------

@query("q_universe", "SELECT ticker, company_name, exchange, sector, industry FROM fx_companies")
def q_universe(spark, folder):
    return Market(spark, folder).companies.select("ticker", "company_name", "exchange", "sector", "industry").orderBy("ticker")


@query("q_benchmark", "SELECT date, close, volume, close / p - 1 AS return_1d FROM (SELECT *, lag(close) OVER (ORDER BY date) AS p FROM fx_benchmark) ORDER BY date DESC LIMIT 1")
def q_benchmark(spark, folder):
    rows = Market(spark, folder).benchmark.withColumn("return_1d", F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1)
    return sv.newest(rows, None, "date", 1).select("date", "close", "volume", "return_1d")


@query("q_actions", "SELECT * FROM fx_actions WHERE ticker = 'S3' ORDER BY ex_date DESC LIMIT 5")
def q_actions(spark, folder):
    return sv.newest(Serving(spark, folder).actions().newest(["S3"], 5), "s3", "ex_date", 5)


@query("q_latest", "SELECT ticker, date, close, volume, source FROM cl_prices WHERE ticker = 'S3' AND analysis_ready ORDER BY date DESC LIMIT 1")
def q_latest(spark, folder):
    return sv.newest(Serving(spark, folder).prices().newest(["S3"], 1), "S3", "date", 1).select("ticker", "date", "close", "volume", "source")


_ASKED = ["S1", "s2 ", "S3", "S5", "S999999"]


@query("q_quotes", """
SELECT p.ticker, p.date, p.close, b.price_vnd, b.source FROM cl_prices p LEFT JOIN board b ON b.ticker = p.ticker
WHERE p.ticker IN ('S1', 'S2', 'S3', 'S5') AND p.analysis_ready AND p.date = (SELECT max(date) FROM cl_prices x WHERE x.ticker = p.ticker AND x.analysis_ready)
""")
def q_quotes(spark, folder):
    serving = Serving(spark, folder)
    asked = [t.strip().upper() for t in _ASKED]
    live = board(serving.market).filter(F.col("ticker").isin(asked)).select("ticker", "price_vnd", "source")
    return sv.quotes(serving.prices().newest(asked, 1), asked).join(live, "ticker", "left")


@query("q_snapshot", "SELECT ticker, as_of_utc, round(pe + 1e-9, 6) AS pe, market_cap, eps_ttm FROM fx_snapshot WHERE ticker = 'S3'")
def q_snapshot(spark, folder):
    return sv.newest(Serving(spark, folder).snapshots().newest(["S3"], 1), "S3", "as_of_utc", 1).select("ticker", "as_of_utc", *rounded(["pe"], 6), "market_cap", "eps_ttm")


@query("q_industry_valuation", "SELECT ticker, classification_field, classification, peer_count, round(median_pe, 6) AS median_pe FROM fx_peers WHERE ticker = 'S3'")
def q_industry_valuation(spark, folder):
    return Serving(spark, folder).peers().of(["S3"]).withColumn("median_pe", F.round("median_pe", 6))


@query("q_prices", "SELECT ticker, date, close FROM (SELECT * FROM cl_prices WHERE ticker = 'S3' AND analysis_ready ORDER BY date DESC LIMIT 180)")
def q_prices(spark, folder):
    return sv.price_range(Serving(spark, folder).prices().newest(["S3"], 180), "S3", "1900-01-01", "2999-12-31", 180).select("ticker", "date", "close")


@query("q_financials", "SELECT ticker, period_end, statement, item_code, value FROM cl_fin WHERE ticker = 'S3' AND row_valid ORDER BY period_end DESC, statement, item_code LIMIT 80")
def q_financials(spark, folder):
    return sv.newest(Serving(spark, folder).financials().newest(["S3"], 80), "S3", "period_end", 80, "statement", "item_code").select("ticker", "period_end", "statement", "item_code", "value")


_SIGNAL = ["ticker", "signal_date", "price", "final_action", "watch_reason", "fa_status", "ta_status", "decision_reason"]


@query("q_signal", f"SELECT {', '.join(_SIGNAL)} FROM fx_signals WHERE ticker = 'S3'")
def q_signal(spark, folder):
    return Serving(spark, folder).signals().of(["S3"]).select(*_SIGNAL)


@query("q_rankings", """
SELECT 'action' AS board, ticker, final_action, round(unified_score + 1e-9, 6) AS unified_score FROM (
  SELECT * FROM fx_signals WHERE final_action = 'WATCH' ORDER BY round(unified_score, 6) DESC NULLS LAST, round(selection_strength, 6) DESC NULLS LAST, ticker LIMIT 10)
UNION ALL SELECT 'screen', ticker, action, round(unified_score + 1e-9, 6) FROM (
  SELECT * FROM st_actions WHERE final_action = 'BUY' ORDER BY round(unified_score, 6) DESC NULLS LAST, round(selection_strength, 6) DESC NULLS LAST, ticker LIMIT 10)
""")
def q_rankings(spark, folder):
    """Rankings by action and by the market-wide screen."""
    rows, _ = assigned_of(Market(spark, folder))
    pick = lambda frame, name: frame.select(F.lit(name).alias("board"), "ticker", "final_action", *rounded(["unified_score"], 6))
    screened = rows.drop("final_action").withColumn("final_action", F.col("screen_action"))
    return pick(sv.rankings(screened, 10, "WATCH"), "action").unionByName(pick(sv.rankings(rows, 10, "SCREEN_BUY"), "screen"))


@query("q_summary", """
SELECT final_action AS name, count(*) AS value FROM fx_signals GROUP BY final_action
UNION ALL SELECT 'total', count(*) FROM fx_signals UNION ALL SELECT 'fa_ready', count(*) FILTER (fa_status = 'READY') FROM fx_signals
UNION ALL SELECT 'fa_pass', count(*) FILTER (fa_pass) FROM fx_signals UNION ALL SELECT 'ta_ready', count(*) FILTER (ta_status = 'READY') FROM fx_signals
""")
def q_summary(spark, folder):
    rows = Serving(spark, folder).signals().rows
    actions = rows.groupBy(F.col("final_action").alias("name")).agg(F.count("*").alias("value"))
    counts = coverage_counts(rows).unpivot([], ["total", "fa_ready", "fa_pass", "ta_ready"], "name", "value")
    return actions.unionByName(counts)


_QUALITY = ["price_rows", "analysis_ready_rows", "rejected_price_rows", "adjusted_rows", "benchmark_rows", "annual_financial_rows", "quarterly_financial_rows", "snapshot_rows"]


@query("q_diagnostics", f"""
SELECT 'fa' AS section, fa_status AS a, coalesce(nullif(hard_reject_reason, ''), 'none') AS b, count(*) AS n FROM fx_signals GROUP BY ALL
UNION ALL SELECT 'ta', ta_status, coalesce(nullif(missing_data_reason, ''), 'none'), count(*) FROM fx_signals GROUP BY ALL
UNION ALL SELECT 'source', source, CAST(count(DISTINCT ticker) AS VARCHAR), count(*) FROM cl_prices GROUP BY source
UNION ALL SELECT 'adjustment', status, CAST(count(DISTINCT ticker) AS VARCHAR), count(*) FROM (
  SELECT b.ticker, CASE WHEN s.bad > 0 THEN 'PARTIAL' WHEN coalesce(s.applied, 0) = 0 THEN 'NOT_REQUIRED' ELSE 'APPLIED' END AS status FROM fx_bars b
  LEFT JOIN (SELECT ticker, count(factor) AS applied, count(*) - count(factor) AS bad FROM act_factors GROUP BY ticker) s ON s.ticker = b.ticker) GROUP BY status
UNION ALL SELECT 'review', ticker, final_action, sessions FROM fx_signals WHERE NOT ta_ready
UNION ALL SELECT 'quality', k, '', v FROM (UNPIVOT (SELECT price_rows, analysis_ready_rows, rejected_price_rows, (SELECT count(close * factor) FROM bar_factors) AS adjusted_rows,
  benchmark_rows, annual_financial_rows, quarterly_financial_rows, snapshot_rows FROM ({_SCALARS})) ON {', '.join(_QUALITY)} INTO NAME k VALUE v)
UNION ALL SELECT 'quality', k, CAST(v AS VARCHAR), NULL FROM (UNPIVOT (SELECT first_market_date, latest_market_date FROM ({_SCALARS}))
  ON first_market_date, latest_market_date INTO NAME k VALUE v)
""")
def q_diagnostics(spark, folder):
    """Breakdowns of the signals, price rows per source and adjustment status, thin histories, and the quality values."""
    serving = Serving(spark, folder)
    market, rows = serving.market, serving.signals().rows
    prices = cleaned(market)
    adjusted = stage(px.adjust_prices(market.staged_bars.select("ticker", "date", "close"), market.actions).groupBy("adjustment_status", "ticker").agg(
        F.count("*").alias("rows"), F.count("adjusted_close").alias("adjusted")), "adjusted")
    statuses = adjusted.groupBy("adjustment_status").agg(F.count("*").alias("tickers"), F.sum("rows").alias("rows"))
    shape = lambda frame, section, a, b, n: frame.select(section.alias("section"), a.alias("a"), b.alias("b"), n.cast("long").alias("n"))
    c_ = F.col
    totals = stage(scalars(market).withColumn("adjusted_rows", adjusted.agg(F.sum("adjusted")).scalar()), "totals")
    days = ["first_market_date", "latest_market_date"]
    return q.union_all([
        shape(breakdowns(rows), c_("layer"), c_("status"), c_("reason"), c_("rows")),
        shape(profile(prices), F.lit("source"), c_("source"), c_("tickers").cast("string"), c_("rows")),
        shape(statuses, F.lit("adjustment"), c_("adjustment_status"), c_("tickers").cast("string"), c_("rows")),
        shape(rows.filter(~c_("ta_ready")), F.lit("review"), c_("ticker"), c_("final_action"), c_("sessions")),
        shape(totals.select(_QUALITY).unpivot([], _QUALITY, "a", "n"), F.lit("quality"), c_("a"), F.lit(""), c_("n")),
        shape(totals.select(days).unpivot([], days, "a", "b"), F.lit("quality"), c_("a"), c_("b").cast("string"), F.lit(None))])


@query("q_model_portfolio", """
SELECT 'position' AS kind, p.ticker, CAST(NULL AS VARCHAR) AS side, s.action AS final_action, s.price AS close FROM st_after p LEFT JOIN st_actions s ON s.ticker = p.ticker WHERE p.entry_date IS NOT NULL
UNION ALL SELECT 'order', o.ticker, o.side, s.action, s.price FROM st_orders o LEFT JOIN st_actions s ON s.ticker = o.ticker
""")
def q_model_portfolio(spark, folder):
    from tapeframe.operators.portfolio import new_orders
    from tapeframe.plans.signals import RUN_DATE
    out, state = assigned_of(Market(spark, folder))
    out = stage(out, "assigned")
    orders = new_orders(out, state, RUN_DATE).select("ticker", F.lit("order").alias("kind"), "side")
    held = state.filter("position IS NOT NULL").select("ticker", F.lit("position").alias("kind"), F.lit(None).cast("string").alias("side"))
    return held.unionByName(orders).join(out.select("ticker", "final_action", F.col("price").alias("close")), "ticker", "left").select(
        "kind", "ticker", "side", "final_action", "close")


@query("q_backtest_stale", "SELECT ticker, max(date) AS latest_date, max(date) > DATE '2001-10-31' AS report_stale FROM cl_prices WHERE analysis_ready GROUP BY ticker")
def q_backtest_stale(spark, folder):
    """Whether an evaluation report of a given date is older than each ticker's newest ready bar, which the index of the published bars knows."""
    rows = Serving(spark, folder).prices().keys().select("ticker", F.col("last").alias("latest_date"))
    return rows.withColumn("report_stale", F.col("latest_date") > F.lit("2001-10-31").cast("date"))


@query("q_health", """
SELECT (SELECT count(*) FROM fx_companies) AS companies, count(*) AS price_rows, max(date) FILTER (analysis_ready) AS latest_market_date, count(*) > 0 AS healthy,
       date_diff('hour', CAST(max(date) FILTER (analysis_ready) AS TIMESTAMP), TIMESTAMP '2001-11-06 12:00:00') AS age_hours FROM cl_prices
""")
def q_health(spark, folder):
    market = Market(spark, folder)
    out = cleaned(market).agg(F.count("*").alias("price_rows"), F.max(F.when(F.col("analysis_ready"), F.col("date"))).alias("latest_market_date"))
    age = ((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("latest_market_date").cast("timestamp"))) / 3600).cast("long")
    return out.withColumns({"companies": market.companies.agg(F.count("*")).scalar(), "healthy": F.col("price_rows") > 0, "age_hours": age})


_ITEMS = """(SELECT f.ticker, count(*) AS n, max(value) FILTER (item_code = 'revenue') AS revenue FROM {0} f
           JOIN (SELECT ticker, max(period_end) AS p FROM {0} WHERE row_valid GROUP BY ticker) m ON m.ticker = f.ticker AND m.p = f.period_end WHERE row_valid GROUP BY f.ticker)"""


@query("ticker_context", f"""
SELECT s.ticker, s.final_action, c.company_name, b.date AS last_date, b.close AS last_close, i.n AS items, i.revenue, qi.n AS quarter_items, qi.revenue AS quarter_revenue,
       a.n AS actions, a.last_type, p.peer_count, n.as_of_utc AS snapshot_at, n.eps_ttm, x.date AS index_date, round(x.close + 1e-9, 6) AS index_close
FROM fx_signals s LEFT JOIN fx_companies c ON c.ticker = s.ticker LEFT JOIN fx_last_bar b ON b.ticker = s.ticker
LEFT JOIN {_ITEMS.format('cl_fin')} i ON i.ticker = s.ticker LEFT JOIN {_ITEMS.format('cl_fin_q')} qi ON qi.ticker = s.ticker
LEFT JOIN (SELECT ticker, least(count(*), 5) AS n, arg_max(action_type, ex_date) AS last_type FROM fx_actions GROUP BY ticker) a ON a.ticker = s.ticker
LEFT JOIN fx_peers p ON p.ticker = s.ticker LEFT JOIN fx_snapshot n ON n.ticker = s.ticker
CROSS JOIN (SELECT date, close FROM fx_benchmark ORDER BY date DESC LIMIT 1) x
""")
def ticker_context(spark, folder):
    market = Market(spark, folder)
    years = stage(annual(market).filter("row_valid"), "annual")
    index = sv.newest(market.staged_benchmark, None, "date", 1)
    out = sv.ticker_context(signals(market).select("ticker", "final_action"), market.staged_bars, years, quarterly(years), market.actions, peer_medians(market),
                            market.companies, snapshot(market), index)
    return out.select("ticker", "final_action", "company.company_name", F.col("prices")[0]["date"].alias("last_date"), F.col("prices")[0]["close"].alias("last_close"),
                      F.size("items").cast("long").alias("items"), F.col("items")["revenue"].alias("revenue"),
                      F.size("quarter_items").cast("long").alias("quarter_items"), F.col("quarter_items")["revenue"].alias("quarter_revenue"),
                      F.size("actions").cast("long").alias("actions"), F.col("actions")[0]["action_type"].alias("last_type"), "peers.peer_count",
                      F.col("snapshot.as_of_utc").alias("snapshot_at"), "snapshot.eps_ttm", F.col("benchmark.date").alias("index_date"),
                      F.round(F.col("benchmark.close") + 1e-9, 6).alias("index_close"))


@query("market_digest", """
SELECT 'benchmark' AS section, 'INDEX' AS ticker, close AS price, NULL AS code FROM (SELECT * FROM fx_benchmark WHERE date <= DATE '2001-07-16' ORDER BY date DESC LIMIT 1)
UNION ALL SELECT CASE action WHEN 'BUY' THEN 'buy' ELSE 'exit' END, ticker, price, code FROM st_actions WHERE action IN ('BUY', 'EXIT')
""")
def market_digest(spark, folder):
    """The day's index row, new buys and exits in one result."""
    market = Market(spark, folder)
    rows, _ = assigned_of(market)
    index = sv.newest(market.staged_benchmark.filter("date <= DATE '2001-07-16'"), None, "date", 1).select(
        F.lit("benchmark").alias("section"), F.lit("INDEX").alias("ticker"), F.col("close").alias("price"), F.lit(None).cast("string").alias("code"))
    acted = rows.filter(F.col("final_action").isin("BUY", "EXIT")).select(
        F.when(F.col("final_action") == "BUY", "buy").otherwise("exit").alias("section"), "ticker", "price", F.col("exit_reason_code").alias("code"))
    return index.unionByName(acted)
