"""Price generations, joins and set operations on the price and statement tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions import cleaning as c
from tapeframe.operators import clean, prices as px
from tapeframe.operators.ranking import first_per_key
from tapeframe.operators.windows import session_ordinals
from tapeframe.plans.cleaning import sql_checksum
from tapeframe.plans.registry import query, rounded, view
from tapeframe.runtime import stage
from tapeframe.sources import landed as L
from tapeframe.sources.driver import Market

# Statement items a company must have.
CRITICAL_ITEMS = [
    "revenue", "cogs", "gross_profit", "ebit", "interest_expense", "profit_before_tax", "net_income", "eps",
    "total_assets", "equity", "cash_and_cash_equivalents", "current_assets", "current_liabilities",
    "short_term_borrowings", "long_term_borrowings", "total_liabilities", "operating_cash_flow", "capex",
    "depreciation", "amortization",
]

_C = ", ".join(f"floor({x} * 100) / 100 AS {x}" for x in ("open", "high", "low", "close"))
NUM = "CAST(substr(ticker, 2) AS BIGINT)"
RUN_ID, OLD_FETCH, NEW_FETCH = "sync-1", "2001-12-01T00:00:00", "2001-12-02T00:00:00"

# The stored generation, and a fetch of each ticker's last two sessions plus one new day for some.
view("gen_old", f"""
SELECT *, {sql_checksum()} AS row_checksum, CASE WHEN source = 'DNSE' THEN {sql_checksum()} END AS source_checksum,
       '{OLD_FETCH}' AS fetched_at, CASE WHEN day(date) % 2 = 0 THEN 1 ELSE 2 END AS data_version
FROM (SELECT ticker, date, {_C}, volume, CASE WHEN {NUM} % 2 = 0 THEN 'DNSE' ELSE 'vnstock KBS' END AS source FROM fx_bars)
""")
view("gen_new", f"""
SELECT *, {sql_checksum()} AS row_checksum, CASE WHEN source = 'DNSE' THEN {sql_checksum()} END AS source_checksum FROM (
  SELECT ticker, date, open, high, low, CASE WHEN {NUM} % 7 = 0 THEN close * 1.01 ELSE close END AS close, volume,
         CASE WHEN {NUM} % 10 = 1 THEN 'DNSE' ELSE source END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM gen_old) WHERE rn <= 2
  UNION ALL
  SELECT ticker, date + 1, open, high, low, close, volume + 10, source
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM gen_old) WHERE rn = 1 AND {NUM} % 3 = 0)
""")


def old_generation(market: Market, bars: DataFrame | None = None) -> DataFrame:
    num = F.expr(L.NUMBER)
    bars = market.staged_bars if bars is None else bars
    rows = bars.select("ticker", "date", *[L.cents(n).alias(n) for n in px.OHLC], "volume",
                       F.when(num % 2 == 0, "DNSE").otherwise("vnstock KBS").alias("source"))
    return clean.with_checksums(rows).withColumns({
        "fetched_at": F.lit(OLD_FETCH), "data_version": F.when(F.dayofmonth("date") % 2 == 0, 1).otherwise(2).cast("long")})


def new_generation(old: DataFrame) -> DataFrame:
    num = F.expr(L.NUMBER)
    facts = ["ticker", "date", *px.OHLC, "volume", "source"]
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = old.select(*facts).withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 2")
    again = last.withColumns({"close": F.when(num % 7 == 0, F.col("close") * 1.01).otherwise(F.col("close")),
                              "source": F.when(num % 10 == 1, "DNSE").otherwise(F.col("source"))})
    extra = last.filter((F.col("_rn") == 1) & (num % 3 == 0)).withColumns(
        {"date": F.date_add("date", 1), "volume": F.col("volume") + 10})
    return clean.with_checksums(again.unionByName(extra).drop("_rn"))


def generations(spark, folder):
    market = Market(spark, folder)
    old = old_generation(market)
    return market, old, new_generation(old)


view("rec_primary", f"""
SELECT * FROM gen_old WHERE ({NUM} + day(date)) % 17 <> 0
""")
view("rec_fallback", f"""
SELECT ticker, date, open * k AS open, high * k AS high, low * k AS low, close * k AS close, volume, 'vnstock VCI' AS source
FROM (SELECT *, CASE WHEN ({NUM} + day(date)) % 13 = 0 THEN 1.3 ELSE 1.0 END AS k FROM gen_old)
""")


@query("full_outer_reconcile", """
SELECT ticker, date, CASE WHEN take THEN f_open ELSE open END AS open, CASE WHEN take THEN f_high ELSE high END AS high,
       CASE WHEN take THEN f_low ELSE low END AS low, CASE WHEN take THEN f_close ELSE close END AS close,
       CASE WHEN take THEN 'vnstock VCI' ELSE source END AS source, source_checksum,
       CASE WHEN source IS NULL THEN 'added' WHEN take THEN 'replaced' ELSE 'primary' END AS origin
FROM (SELECT coalesce(p.ticker, f.ticker) AS ticker, coalesce(p.date, f.date) AS date, p.open, p.high, p.low, p.close, p.source,
        p.source_checksum, f.open AS f_open, f.high AS f_high, f.low AS f_low, f.close AS f_close,
        p.source IS NULL OR coalesce(f.high >= greatest(f.open, f.close, f.low) AND f.low <= least(f.open, f.close, f.high)
          AND f.low >= 0 AND abs(p.close / nullif(f.close, 0) - 1) > 0.2, false) AS take
      FROM rec_primary p FULL JOIN rec_fallback f ON p.ticker = f.ticker AND p.date = f.date)
""")
def full_outer_reconcile(spark, folder):
    market = Market(spark, folder)
    old = old_generation(market)
    shift = F.expr(L.NUMBER) + F.dayofmonth("date")
    k = F.when(shift % 13 == 0, 1.3).otherwise(1.0)
    facts = ["ticker", "date", *px.OHLC, "volume", "source", "source_checksum"]
    primary = old.filter(shift % 17 != 0).select(*facts)
    fallback = old.withColumns({n: F.col(n) * k for n in px.OHLC}).withColumns(
        {"source": F.lit("vnstock VCI"), "source_checksum": F.lit(None).cast("string")}).select(*facts)
    return px.reconcile(primary, fallback).select("ticker", "date", *px.OHLC, "source", "source_checksum", "origin")


@query("upsert_prices", """
SELECT ticker, date, open, high, low, close, volume, source FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY is_new DESC, source, close) AS rn FROM (
    SELECT ticker, date, open, high, low, close, volume, source, 0 AS is_new FROM gen_old
    UNION ALL SELECT ticker, date, open, high, low, close, volume, source, 1 FROM gen_new)) WHERE rn = 1
""")
def upsert_prices(spark, folder):
    _, old, new = generations(spark, folder)
    return px.upsert(old, new).select("ticker", "date", *px.OHLC, "volume", "source")


_CHANGED = "(o.row_checksum <> coalesce(n.row_checksum, '') OR coalesce(o.source_checksum, '') <> coalesce(n.source_checksum, ''))"
_REV = ", ".join(f"o.{x} AS old_{x}, n.{x} AS new_{x}" for x in
                 ("open", "high", "low", "close", "volume", "source", "row_checksum", "source_checksum"))
view("revs", f"""
SELECT '{RUN_ID}' AS sync_run_id, o.ticker, o.date, 'daily_overlap' AS reason, 'updated' AS change_type, {_REV}
FROM gen_old o JOIN gen_new n ON o.ticker = n.ticker AND o.date = n.date WHERE {_CHANGED}
""")


@query("revision_rows", "SELECT * FROM revs")
def revision_rows(spark, folder):
    _, old, new = generations(spark, folder)
    return px.revisions(old, new, RUN_ID, "daily_overlap")


@query("revision_rows_with_removed", f"""
SELECT '{RUN_ID}' AS sync_run_id, o.ticker, o.date, 'scheduled_history_audit' AS reason,
       CASE WHEN n.ticker IS NULL THEN 'deleted' ELSE 'updated' END AS change_type, {_REV}
FROM gen_old o LEFT JOIN gen_new n ON o.ticker = n.ticker AND o.date = n.date WHERE n.ticker IS NULL OR {_CHANGED}
""")
def revision_rows_with_removed(spark, folder):
    _, old, new = generations(spark, folder)
    return px.revisions(old, new, RUN_ID, "scheduled_history_audit", include_removed=True)


@query("source_restatements", """
SELECT ticker, date, old_source_checksum, new_source_checksum FROM revs
WHERE old_source_checksum IS NOT NULL AND new_source_checksum IS NOT NULL AND old_source_checksum <> new_source_checksum
""")
def source_restatements(spark, folder):
    _, old, new = generations(spark, folder)
    return px.source_restatements(px.revisions(old, new, RUN_ID, "overlap")).select(
        "ticker", "date", "old_source_checksum", "new_source_checksum")


@query("confirm_restatement", f"""
SELECT ticker, count(*) AS expected, count(*) FILTER (WHERE {NUM} % 4 = 0) AS unconfirmed FROM revs
WHERE old_source_checksum IS NOT NULL AND new_source_checksum IS NOT NULL AND old_source_checksum <> new_source_checksum GROUP BY ticker
""")
def confirm_restatement(spark, folder):
    """A second fetch that lost every fourth ticker's change: those restatements stay unconfirmed."""
    _, old, new = generations(spark, folder)
    expected = px.source_restatements(px.revisions(old, new, RUN_ID, "overlap"))
    second = new.filter(F.expr(L.NUMBER) % 4 != 0)
    observed = px.source_restatements(px.revisions(old, second, RUN_ID, "overlap"))
    missing = px.unconfirmed(expected, observed).groupBy("ticker").agg(F.count("*").alias("unconfirmed"))
    return expected.groupBy("ticker").agg(F.count("*").alias("expected")).join(missing, "ticker", "left").select(
        "ticker", "expected", F.coalesce("unconfirmed", F.lit(0)).alias("unconfirmed"))


view("lineage", f"""
SELECT n.ticker, n.date, n.close, n.row_checksum, CASE WHEN same THEN old_at ELSE '{NEW_FETCH}' END AS fetched_at,
       CASE WHEN same THEN old_v ELSE coalesce(old_v + 1, 1) END AS data_version
FROM (SELECT n.*, o.fetched_at AS old_at, o.data_version AS old_v,
             coalesce(o.row_checksum = n.row_checksum AND coalesce(o.source_checksum, '') = coalesce(n.source_checksum, ''), false) AS same
      FROM gen_new n LEFT JOIN gen_old o ON o.ticker = n.ticker AND o.date = n.date) n
""")


@query("apply_lineage", "SELECT * FROM lineage")
def apply_lineage(spark, folder):
    _, old, new = generations(spark, folder)
    return px.apply_lineage(new, old, NEW_FETCH).select("ticker", "date", "close", "row_checksum", "fetched_at", "data_version")


@query("lineage_backfill", f"""
SELECT ticker, date, row_checksum, CASE WHEN day(date) % 3 = 0 THEN '{NEW_FETCH}' ELSE fetched_at END AS fetched_at,
       CASE WHEN day(date) % 5 = 0 THEN 1 ELSE data_version END AS data_version FROM gen_old
""")
def lineage_backfill(spark, folder):
    day = F.dayofmonth("date")
    old = old_generation(Market(spark, folder))
    holes = old.withColumns({"fetched_at": F.when(day % 3 != 0, F.col("fetched_at")),
                             "data_version": F.when(day % 5 != 0, F.col("data_version")),
                             "row_checksum": F.when(day % 7 != 0, F.col("row_checksum"))})
    return px.backfill_lineage(holes, NEW_FETCH).select("ticker", "date", "row_checksum", "fetched_at", "data_version")


_PRE = "(SELECT close FROM fx_bars b WHERE b.ticker = a.ticker AND b.date < a.ex_date ORDER BY b.date DESC LIMIT 1)"
view("act_factors", f"""
SELECT *, CASE WHEN pre > 0 AND f > 0 AND f <= 1.5 THEN f END AS factor FROM (
  SELECT *, CASE action_type WHEN 'cash_dividend' THEN CASE WHEN cash > 0 AND cash < pre THEN (pre - cash) / pre END
       WHEN 'stock_dividend' THEN 1 / (1 + stock_ratio / 100) WHEN 'stock_split' THEN 1 / split_ratio
       WHEN 'rights_issue' THEN (pre + rights_ratio * rights_price) / (pre * (1 + rights_ratio)) END AS f
  FROM (SELECT a.*, cash_dividend AS cash, {_PRE} AS pre FROM fx_actions a))
WHERE pre IS NOT NULL
""")
view("bar_factors", """
SELECT b.ticker, b.date, b.close, count(a.ex_date) AS later_actions, coalesce(product(a.factor), 1.0) AS factor
FROM fx_bars b LEFT JOIN act_factors a ON a.ticker = b.ticker AND a.ex_date > b.date GROUP BY b.ticker, b.date, b.close
""")


@query("theta_action_adjust", "SELECT ticker, date, later_actions, round(factor, 9) AS factor FROM bar_factors")
def theta_action_adjust(spark, folder):
    market = Market(spark, folder)
    line = px.action_line(market.staged_bars.select("ticker", "date", "close"), market.actions)
    later = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("_side").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    return line.withColumns({
        "later_actions": F.count(F.when(F.col("_applies"), F.lit(1))).over(later),
        "factor": F.round(F.coalesce(F.product(F.col("_factor")).over(later), F.lit(1.0)), 9),
    }).filter("_side = 1").select("ticker", "date", "later_actions", "factor")


@query("adjust_prices", """
SELECT b.ticker, b.date, round(b.open * f.factor + 1e-9, 5) AS adjusted_open, round(b.high * f.factor + 1e-9, 5) AS adjusted_high,
       round(b.low * f.factor + 1e-9, 5) AS adjusted_low, round(b.close * f.factor + 1e-9, 5) AS adjusted_close,
       CASE WHEN s.bad > 0 THEN 'PARTIAL' WHEN coalesce(s.applied, 0) = 0 THEN 'NOT_REQUIRED' ELSE 'APPLIED' END AS adjustment_status
FROM fx_bars b JOIN bar_factors f ON f.ticker = b.ticker AND f.date = b.date
LEFT JOIN (SELECT ticker, count(factor) AS applied, count(*) - count(factor) AS bad FROM act_factors GROUP BY ticker) s ON s.ticker = b.ticker
""")
def adjust_prices(spark, folder):
    market = Market(spark, folder)
    out = px.adjust_prices(market.staged_bars.select("ticker", "date", *px.OHLC), market.actions)
    return out.select("ticker", "date", *rounded([f"adjusted_{n}" for n in px.OHLC], 5), "adjustment_status")


@query("adjust_prices_by_source", f"""
SELECT a.ticker, a.date, round(a.close * CASE WHEN {NUM.replace('ticker', 'a.ticker')} % 3 = 0 THEN 1 ELSE a.factor END + 1e-9, 5) AS adjusted_close,
       CASE WHEN {NUM.replace('ticker', 'a.ticker')} % 3 = 0 THEN 'SOURCE_ADJUSTED' WHEN s.bad > 0 THEN 'PARTIAL' WHEN coalesce(s.applied, 0) = 0 THEN 'NOT_REQUIRED' ELSE 'APPLIED' END AS adjustment_status
FROM bar_factors a LEFT JOIN (SELECT ticker, count(factor) AS applied, count(*) - count(factor) AS bad FROM act_factors GROUP BY ticker) s ON s.ticker = a.ticker
""")
def adjust_prices_by_source(spark, folder):
    """Tickers whose every bar comes already adjusted keep their prices; the others are adjusted."""
    market = Market(spark, folder)
    source = F.when((F.expr(L.NUMBER) % 3 == 0) & (F.dayofmonth("date") % 2 == 0), "DNSE").when(
        F.expr(L.NUMBER) % 3 == 0, "vnstock KBS").when(F.dayofmonth("date") % 2 == 0, "DNSE").otherwise("manual")
    rows = market.staged_bars.select("ticker", "date", "close", source.alias("source"))
    out = px.adjust_prices(rows, market.actions, px.source_is_adjusted(F.col("source")))
    return out.select("ticker", "date", *rounded(["adjusted_close"], 5), "adjustment_status")


# --- dedupes and statement sources -------------------------------------------------

@query("dedupe_prices", f"""
SELECT ticker, date, source, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY source_priority, source, close, volume) AS rn
FROM ld_typed) WHERE rn = 1
""")
def dedupe_prices(spark, folder):
    return clean.best_price_rows(clean.typed_prices(L.Landed(Market(spark, folder)).prices())).select(
        "ticker", "date", "source", "close", "volume")


@query("dedupe_financials", """
SELECT ticker, statement, item_code, count(*) AS kept, sum(n - 1)::BIGINT AS removed FROM (
  SELECT ticker, statement, item_code, fiscal_year, count(*) AS n FROM ld_fin GROUP BY ALL) GROUP BY ALL
""")
def dedupe_financials(spark, folder):
    landed = L.Landed(Market(spark, folder)).financials()
    keys = ["ticker", "statement", "item_code"]
    kept = clean.financials(landed, "annual").groupBy(*keys).agg(F.count("*").alias("kept"))
    total = landed.groupBy(*keys).agg(F.count("*").alias("total"))
    return kept.join(total, keys).select(*keys, "kept", (F.col("total") - F.col("kept")).alias("removed"))


@query("dedupe_actions", "SELECT ticker, ex_date, action_type, 'vnstock KBS' AS source FROM cl_actions")
def dedupe_actions(spark, folder):
    rows = clean.classified_actions(L.Landed(Market(spark, folder)).action_events())
    both = rows.withColumn("source", F.lit("vnstock VCI")).unionByName(rows.withColumn("source", F.lit("vnstock KBS")))
    return clean.actions(both).select("ticker", "ex_date", "action_type", "source")


view("merged_fin", """
SELECT ticker, statement, report_period, period_type, item_code, any_value(value) FILTER (rn = 1) AS value,
       string_agg(source, ' | ' ORDER BY source) AS source, arg_min(published_date, source) FILTER (published_date IS NOT NULL) AS published_date,
       count(*) AS candidates, count(value) > 1 AND coalesce(abs(max(value) FILTER (source = 'vnstock VCI') - max(value) FILTER (source = 'DNSE'))
         / greatest(abs(max(value) FILTER (source = 'DNSE')), 1) > 0.02, false) AS mismatch
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, statement, report_period, period_type, item_code ORDER BY source) AS rn FROM ld_fin)
GROUP BY ALL
""")


@query("merge_financial_sources", "SELECT ticker, statement, report_period, item_code, value, source, published_date, candidates FROM merged_fin")
def merge_financial_sources(spark, folder):
    out = px.merge_financial_sources(L.Landed(Market(spark, folder)).financials(), "dnse")
    return out.select("ticker", "statement", "report_period", "item_code", "value", "source", "published_date", "candidates")


@query("cross_source_mismatch", "SELECT ticker, report_period, item_code, value FROM merged_fin WHERE mismatch")
def cross_source_mismatch(spark, folder):
    out = px.merge_financial_sources(L.Landed(Market(spark, folder)).financials(), "dnse")
    return out.filter("mismatch").select("ticker", "report_period", "item_code", "value")


@query("anti_fallback_gaps", f"""
SELECT ticker, report_period, item_code, value FROM (
  SELECT *, bool_or(source = 'DNSE') OVER (PARTITION BY ticker, statement, report_period, period_type, item_code) AS covered
  FROM ld_fin WHERE item_code IN ({', '.join(repr(n) for n in CRITICAL_ITEMS)})) WHERE NOT covered
""")
def anti_fallback_gaps(spark, folder):
    """Fallback cells of required items that the primary source lacks; the statements are planned once."""
    rows = stage(L.Landed(Market(spark, folder)).financials(), "financials")
    keys = ["ticker", "statement", "report_period", "period_type", "item_code"]
    required = rows.filter((F.col("source") != "DNSE") & F.col("item_code").isin(*CRITICAL_ITEMS))
    return required.join(rows.filter("source = 'DNSE'").select(*keys), keys, "left_anti").select(
        "ticker", "report_period", "item_code", "value")


@query("pivot_financials", "SELECT ticker, report_period, fiscal_year, period_end, " + ", ".join(
    f"max(CASE WHEN item_code = '{n}' THEN value END) AS {n}" for n in L.ITEMS)
    + " FROM cl_fin WHERE row_valid GROUP BY ticker, report_period, fiscal_year, period_end")
def pivot_financials(spark, folder):
    rows = clean.financials(L.Landed(Market(spark, folder)).financials(), "annual")
    return px.pivot_items(rows, list(L.ITEMS))


@query("join_one_to_one", """
SELECT k.ticker, k.report_period, k.period_end, w.items, true AS one_to_one
FROM (SELECT DISTINCT ticker, report_period, period_end FROM cl_fin WHERE row_valid) k
JOIN (SELECT ticker, report_period, count(*) AS items FROM cl_fin WHERE row_valid GROUP BY ticker, report_period) w
  ON w.ticker = k.ticker AND w.report_period = k.report_period
""")
def join_one_to_one(spark, folder):
    """Period keys joined to their wide rows, with the proof that no key occurs twice on either side."""
    rows = clean.financials(L.Landed(Market(spark, folder)).financials(), "annual").filter("row_valid")
    keys = ["ticker", "report_period"]
    left = rows.select(*keys, "period_end").distinct().withColumn("_k", F.count("*").over(Window.partitionBy(*keys)))
    right = rows.groupBy(*keys).agg(F.count("*").alias("items"))
    return left.join(right, keys).select(*keys, "period_end", "items", (F.col("_k") == 1).alias("one_to_one"))


@query("financial_row_valid", "SELECT ticker, report_period, item_code, row_valid, point_in_time_ready FROM cl_fin")
def financial_row_valid(spark, folder):
    return clean.financials(L.Landed(Market(spark, folder)).financials(), "annual").select(
        "ticker", "report_period", "item_code", "row_valid", "point_in_time_ready")


@query("action_row_valid", """
SELECT DISTINCT ticker, ex_date, action_type, ex_date IS NOT NULL AND action_type IS NOT NULL AS row_valid FROM (
  SELECT ticker, CASE WHEN NUM % 4 <> 0 THEN ex_date END AS ex_date, action_type FROM fx_actions)
""".replace("NUM", NUM))
def action_row_valid(spark, folder):
    rows = Market(spark, folder).actions.withColumn("ex_date", F.when(F.expr(L.NUMBER) % 4 != 0, F.col("ex_date")))
    return clean.actions(rows.withColumn("source", F.lit("x"))).select("ticker", "ex_date", "action_type", "row_valid")


# --- joins over the published tables ------------------------------------------------

@query("semi_active_universe", f"SELECT ticker, date, close FROM fx_bars WHERE ticker IN (SELECT ticker FROM fx_companies WHERE exchange = 'HOSE')")
def semi_active_universe(spark, folder):
    market = Market(spark, folder)
    active = market.companies.filter("exchange = 'HOSE'").select("ticker")
    return market.bars.join(active, "ticker", "left_semi").select("ticker", "date", "close")


@query("latest_per_key_subquery", "SELECT b.ticker, b.date, b.close FROM fx_bars b WHERE b.date = (SELECT max(x.date) FROM fx_bars x WHERE x.ticker = b.ticker)")
def latest_per_key_subquery(spark, folder):
    return first_per_key(Market(spark, folder).bars, ["ticker"], [F.col("date").desc()]).select("ticker", "date", "close")


@query("join_market_company", """
SELECT b.ticker, b.date, b.close AS price, c.company_name, c.exchange FROM fx_last_bar b LEFT JOIN fx_companies c ON c.ticker = b.ticker
""")
def join_market_company(spark, folder):
    market = Market(spark, folder)
    last = first_per_key(market.bars, ["ticker"], [F.col("date").desc()])
    return last.join(market.companies, "ticker", "left").select(
        "ticker", "date", F.col("close").alias("price"), "company_name", "exchange")


@query("join_range_sessions", """
SELECT a.ticker, a.ex_date AS entry_date, (SELECT count(*) FROM fx_sessions s WHERE s.date > a.ex_date AND s.date <= DATE '2001-07-16') AS holding_sessions
FROM fx_actions a WHERE a.ex_date <= DATE '2001-07-16'
""")
def join_range_sessions(spark, folder):
    """Sessions in (entry, as-of] as a difference of two session numbers, for every action date."""
    market = Market(spark, folder)
    ordinals = session_ordinals(market.staged_bars)
    as_of = F.lit("2001-07-16").cast("date")
    upto = ordinals.filter(F.col("date") <= as_of).agg(F.max("session")).scalar()
    return market.actions.filter(F.col("ex_date") <= as_of).join(
        ordinals.withColumnRenamed("date", "ex_date"), "ex_date").select(
        "ticker", F.col("ex_date").alias("entry_date"), (upto - F.col("session")).alias("holding_sessions"))


@query("union_sources", """
SELECT DISTINCT source FROM (SELECT source FROM ld_prices UNION SELECT 'INDEX' UNION SELECT source FROM ld_fin UNION SELECT 'vnstock KBS')
""")
def union_sources(spark, folder):
    market = Market(spark, folder)
    landed = L.Landed(market)
    parts = [landed.prices().select("source"), landed.financials().select("source"),
             market.benchmark.select(F.lit("INDEX").alias("source")), market.actions.select(F.lit("vnstock KBS").alias("source"))]
    out = parts[0].distinct()
    for part in parts[1:]:
        out = out.union(part.distinct())
    return out.distinct()


view("cl_fin_q", """
SELECT f.ticker, f.statement, concat(f.report_period, '-Q', q) AS report_period, f.item_code, f.value / 4 AS value, f.source,
       last_day(make_date(f.fiscal_year, CAST(q * 3 AS BIGINT), 1)) AS period_end, f.fiscal_year, CAST(q AS BIGINT) AS fiscal_quarter, f.row_valid, f.unit
FROM cl_fin f CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(q)
""")


def quarterly(annual: DataFrame) -> DataFrame:
    """A quarterly table from the annual one: a quarter of each value, per quarter."""
    rows = annual.withColumn("q", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    period = F.concat("report_period", F.lit("-Q"), F.col("q").cast("string"))
    return rows.select("ticker", "statement", period.alias("report_period"), "item_code", (F.col("value") / 4).alias("value"),
                       "source", c.period_end(period).alias("period_end"), "fiscal_year",
                       F.col("q").cast("long").alias("fiscal_quarter"), "row_valid", "unit")


@query("union_all_periods", """
SELECT ticker, 1 AS period_kind, period_end, fiscal_year, CAST(NULL AS BIGINT) AS fiscal_quarter, statement, item_code, value, source FROM cl_fin WHERE row_valid
UNION ALL SELECT ticker, 2, period_end, fiscal_year, fiscal_quarter, statement, item_code, value, source FROM cl_fin_q WHERE row_valid
""")
def union_all_periods(spark, folder):
    return all_periods(clean.financials(L.Landed(Market(spark, folder)).financials(), "annual"))


def all_periods(annual: DataFrame) -> DataFrame:
    columns = ["period_end", "fiscal_year", "fiscal_quarter", "statement", "item_code", "value", "source"]

    def part(rows, kind):
        return rows.filter("row_valid").select("ticker", F.lit(kind).alias("period_kind"), *columns)

    return part(annual, 1).unionByName(part(quarterly(annual), 2))


@query("except_missing_items", f"""
SELECT t.ticker, i.item_code FROM (SELECT DISTINCT ticker FROM ld_fin) t CROSS JOIN
  (SELECT unnest([{', '.join(repr(n) for n in CRITICAL_ITEMS)}]) AS item_code) i
EXCEPT SELECT ticker, item_code FROM ld_fin WHERE source = 'DNSE'
""")
def except_missing_items(spark, folder):
    """Required items that a ticker's primary source never has; at most one array of items per ticker."""
    rows = L.Landed(Market(spark, folder)).financials()
    mine = F.collect_set(F.when(F.col("source") == "DNSE", F.col("item_code")))
    required = F.array(*[F.lit(n) for n in CRITICAL_ITEMS])
    return rows.groupBy("ticker").agg(mine.alias("have")).select(
        "ticker", F.explode(F.array_except(required, "have")).alias("item_code"))


@query("item_dictionary", """
SELECT item_code, max(statement) AS item_name, max(unit) AS unit FROM (
  SELECT item_code, statement, unit FROM cl_fin UNION ALL SELECT item_code, statement, unit FROM cl_fin_q) GROUP BY item_code
""")
def item_dictionary(spark, folder):
    annual = clean.financials(L.Landed(Market(spark, folder)).financials(), "annual")
    cols = ["item_code", "statement", "unit"]
    return annual.select(*cols).unionAll(quarterly(annual).select(*cols)).groupBy("item_code").agg(
        F.max("statement").alias("item_name"), F.max("unit").alias("unit"))


@query("price_range", """
SELECT ticker, date, close FROM (SELECT * FROM cl_prices WHERE ticker = 'S3' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND analysis_ready
ORDER BY date DESC LIMIT 100) ORDER BY date
""")
def price_range(spark, folder):
    from tapeframe.operators.serving import price_range as read
    rows = clean.prices(L.Landed(Market(spark, folder)).prices())
    return read(rows, "S3", "1996-01-01", "2000-12-31", 100).select("ticker", "date", "close")
