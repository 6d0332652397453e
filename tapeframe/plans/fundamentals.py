"""Fundamental-analysis queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators import fundamentals as fa
from tapeframe.operators.ranking import first_per_key, grouped_median
from tapeframe.params import ON_FIXTURES
from tapeframe.plans.registry import query, rounded, sql_round, view
from tapeframe.sources.driver import Market

# Current ratios per ticker: the provider's P/E for every third ticker, its P/B for every fourth.
view("fx_snapshot", """
SELECT ticker, market_cap, net_income AS net_income_ttm, eps AS eps_ttm,
       CASE WHEN num % 3 = 0 THEN market_cap / nullif(net_income, 0) * 1.1 END AS pe,
       CASE WHEN num % 4 = 0 THEN market_cap / nullif(equity, 0) * 0.9 END AS pb, as_of_utc
FROM (SELECT f.ticker, c.market_cap, f.net_income, f.eps, f.equity, f.period_end AS as_of_utc,
             CAST(substr(f.ticker, 2) AS BIGINT) AS num,
             row_number() OVER (PARTITION BY f.ticker ORDER BY f.period_end DESC) AS rn
      FROM fx_fin_wide f JOIN fx_companies c ON f.ticker = c.ticker) WHERE rn = 1
""")


def snapshot(market: Market) -> DataFrame:
    newest = first_per_key(market.fin_wide.join(market.companies.select("ticker", "market_cap"), "ticker"),
                           ["ticker"], [F.col("period_end").desc()])
    num = F.substring("ticker", 2, 20).cast("long")
    return newest.select(
        "ticker", "market_cap", F.col("net_income").alias("net_income_ttm"), F.col("eps").alias("eps_ttm"),
        F.when(num % 3 == 0, F.try_divide("market_cap", "net_income") * 1.1).alias("pe"),
        F.when(num % 4 == 0, F.try_divide("market_cap", "equity") * 0.9).alias("pb"),
        F.col("period_end").alias("as_of_utc"))


view("fx_reports", """
SELECT f.*, (p1.equity) AS p1_equity, p1.total_assets AS p1_assets, p1.net_income AS p1_income,
       p1.operating_cash_flow AS p1_cfo, p3.revenue AS p3_revenue, p3.eps AS p3_eps, p3.gross_profit AS p3_gross,
       (SELECT CASE WHEN count(*) >= 3 THEN stddev_pop(x) / nullif(abs(avg(x)), 0) END
        FROM (SELECT h.net_income AS x FROM fx_fin_wide h
              WHERE h.ticker = f.ticker AND h.fiscal_year <= f.fiscal_year AND h.net_income IS NOT NULL
              ORDER BY h.fiscal_year DESC LIMIT 5)) AS earnings_stability
FROM fx_fin_wide f
LEFT JOIN fx_fin_wide p1 ON p1.ticker = f.ticker AND p1.fiscal_year = f.fiscal_year - 1
LEFT JOIN fx_fin_wide p3 ON p3.ticker = f.ticker AND p3.fiscal_year = f.fiscal_year - 3
""")
view("fx_latest_report", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rn FROM fx_reports) WHERE rn = 1
""")

_EBITDA = "nullif(ebit + depreciation + amortization, 0)"
_DEBT = "(short_term_borrowings + long_term_borrowings)"
_RATE = "(profit_before_tax - net_income) / nullif(profit_before_tax, 0)"
_TAX = f"CASE WHEN {_RATE} IS NULL THEN 0.20 ELSE least(greatest({_RATE}, 0), 0.35) END"
REPORT_RATIOS = f"""
  net_income / nullif((equity + p1_equity) / 2, 0) AS roe,
  net_income / nullif((total_assets + p1_assets) / 2, 0) AS roa,
  ebit * (1 - ({_TAX})) / nullif(equity + {_DEBT} - cash_and_cash_equivalents, 0) AS roic,
  net_income / nullif(revenue, 0) AS profit_margin, operating_cash_flow / nullif(net_income, 0) AS cash_flow_quality,
  CASE WHEN revenue > 0 AND p3_revenue > 0 THEN pow(revenue / p3_revenue, 1.0 / 3) - 1 END AS revenue_cagr_3y,
  CASE WHEN eps > 0 AND p3_eps > 0 THEN pow(eps / p3_eps, 1.0 / 3) - 1 END AS eps_cagr_3y,
  net_income / nullif(p1_income, 0) - 1 AS profit_growth,
  gross_profit / nullif(revenue, 0) - p3_gross / nullif(p3_revenue, 0) AS margin_expansion_3y,
  {_DEBT} / nullif(equity, 0) AS debt_equity, ({_DEBT} - cash_and_cash_equivalents) / {_EBITDA} AS net_debt_ebitda,
  ebit / nullif(abs(interest_expense), 0) AS interest_coverage,
  current_assets / nullif(current_liabilities, 0) AS current_ratio, earnings_stability
"""


def sql_metrics(market_cap: str, pe: str, pb: str, source: str) -> str:
    return f"""
SELECT *, pe / nullif(median(CASE WHEN pe > 0 THEN pe END) OVER (PARTITION BY sector), 0) AS sector_relative_value
FROM (SELECT c.ticker, c.sector, c.industry, c.trading_status, c.company_name, c.exchange, net_income, equity,
        operating_cash_flow, p1_cfo, {REPORT_RATIOS},
        net_income / nullif({market_cap}, 0) AS earnings_yield,
        coalesce({pe}, {market_cap} / nullif(net_income, 0)) AS pe, coalesce({pb}, {market_cap} / nullif(equity, 0)) AS pb,
        ({market_cap} + {_DEBT} - cash_and_cash_equivalents) / {_EBITDA} AS ev_ebitda
      FROM {source})"""


view("fx_metrics", sql_metrics("s.market_cap", "s.pe", "s.pb", """
fx_companies c LEFT JOIN fx_latest_report r ON r.ticker = c.ticker LEFT JOIN fx_snapshot s ON s.ticker = c.ticker"""))
view("fx_metrics_basis", sql_metrics("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)",
                                     "fx_companies c LEFT JOIN fx_latest_report r ON r.ticker = c.ticker"))
# Every report scored as the newest one.
view("fx_metrics_reports", sql_metrics("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)",
                                       "fx_companies c JOIN fx_reports r ON r.ticker = c.ticker")
     .replace("c.exchange,", "c.exchange, r.period_end,"))


def sql_bucket(name: str) -> str:
    return {
        "cash_flow_quality": "CASE WHEN {x} >= 1 THEN 100 WHEN {x} >= 0.7 THEN 70 WHEN {x} > 0 THEN 30 WHEN {x} <= 0 THEN 0 END",
        "margin_expansion_3y": "CASE WHEN {x} > 0.02 THEN 100 WHEN {x} >= 0 THEN 60 WHEN {x} < 0 THEN 0 END",
        "pe": "CASE WHEN {x} > 0 AND {x} <= 10 THEN 100 WHEN {x} > 10 AND {x} <= 15 THEN 75 WHEN {x} > 15 AND {x} <= 22 THEN 40 WHEN {x} <= 0 OR {x} > 22 THEN 0 END",
        "pb": "CASE WHEN {x} > 0 AND {x} <= 1.2 THEN 100 WHEN {x} > 1.2 AND {x} <= 2 THEN 70 WHEN {x} > 2 AND {x} <= 3.5 THEN 30 WHEN {x} <= 0 OR {x} > 3.5 THEN 0 END",
        "roe": "CASE WHEN {x} >= 0.2 THEN 100 WHEN {x} >= 0.15 THEN 80 WHEN {x} >= 0.1 THEN 50 WHEN {x} < 0.1 THEN 0 END",
        "roa": "CASE WHEN {x} >= 0.1 THEN 100 WHEN {x} >= 0.07 THEN 75 WHEN {x} >= 0.05 THEN 50 WHEN {x} < 0.05 THEN 0 END",
        "roic": "CASE WHEN {x} >= 0.15 THEN 100 WHEN {x} >= 0.1 THEN 70 WHEN {x} < 0.1 THEN 20 END",
        "profit_margin": "CASE WHEN {x} >= 0.15 THEN 100 WHEN {x} >= 0.1 THEN 75 WHEN {x} >= 0.05 THEN 40 WHEN {x} < 0.05 THEN 0 END",
        "earnings_stability": "CASE WHEN {x} <= 0.2 THEN 100 WHEN {x} <= 0.5 THEN 60 WHEN {x} > 0.5 THEN 20 END",
        "revenue_cagr_3y": "CASE WHEN {x} >= 0.2 THEN 100 WHEN {x} >= 0.12 THEN 75 WHEN {x} >= 0.05 THEN 40 WHEN {x} < 0.05 THEN 0 END",
        "eps_cagr_3y": "CASE WHEN {x} >= 0.2 THEN 100 WHEN {x} >= 0.12 THEN 75 WHEN {x} >= 0.05 THEN 40 WHEN {x} < 0.05 THEN 0 END",
        "profit_growth": "CASE WHEN {x} >= 0.25 THEN 100 WHEN {x} >= 0.15 THEN 75 WHEN {x} >= 0 THEN 40 WHEN {x} < 0 THEN 0 END",
        "earnings_yield": "CASE WHEN {x} >= 0.1 THEN 100 WHEN {x} >= 0.065 THEN 70 WHEN {x} < 0.065 THEN 20 END",
        "ev_ebitda": "CASE WHEN {x} <= 6 THEN 100 WHEN {x} <= 10 THEN 70 WHEN {x} > 10 THEN 20 END",
        "sector_relative_value": "CASE WHEN {x} <= 0.8 THEN 100 WHEN {x} <= 1 THEN 75 WHEN {x} <= 1.2 THEN 40 WHEN {x} > 1.2 THEN 20 END",
        "debt_equity": "CASE WHEN {x} <= 0.5 THEN 100 WHEN {x} <= 1 THEN 75 WHEN {x} <= 2 THEN 40 WHEN {x} > 2 THEN 0 END",
        "net_debt_ebitda": "CASE WHEN {x} <= 1.5 THEN 100 WHEN {x} <= 3 THEN 60 WHEN {x} > 3 THEN 0 END",
        "interest_coverage": "CASE WHEN {x} >= 5 THEN 100 WHEN {x} >= 3 THEN 70 WHEN {x} >= 1.5 THEN 30 WHEN {x} < 1.5 THEN 0 END",
        "current_ratio": "CASE WHEN {x} >= 1.5 THEN 100 WHEN {x} >= 1 THEN 60 WHEN {x} < 1 THEN 0 END",
    }[name].format(x=name)


SCORES = ", ".join(f"CAST({sql_bucket(f)} AS DOUBLE) AS {f}_score" for f in fa.FACTORS)
WEIGHTS = {"quality": 0.40, "growth": 0.25, "value": 0.20, "safety": 0.15}


def sql_scored(source: str) -> str:
    lists = {g: "[" + ", ".join(f"{n}_score" for n in names) + "]" for g, names in fa.GROUPS.items()}
    means = ", ".join(f"list_avg({text}) AS {g}_score, len(list_filter({text}, lambda x: x IS NOT NULL)) / {float(len(fa.GROUPS[g]))} AS {g}_coverage"
                      for g, text in lists.items())
    total = " + ".join(f"coalesce({g}_score, 0) * {w}" for g, w in WEIGHTS.items())
    weight = " + ".join(f"CASE WHEN {g}_score IS NOT NULL THEN {w} ELSE 0 END" for g, w in WEIGHTS.items())
    coverage = " + ".join(f"{g}_coverage * {w}" for g, w in WEIGHTS.items())
    return f"""
SELECT *, CASE WHEN fa_coverage >= 0.5 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS fa_status,
       coalesce(fa_coverage >= 0.5 AND fa_score >= 65 AND hard_reject_reason = '', false) AS fa_pass
FROM (SELECT *, CAST(({total}) / nullif({weight}, 0) AS DOUBLE) AS fa_score, CAST({coverage} AS DOUBLE) AS fa_coverage,
        CASE WHEN net_income <= 0 THEN 'net_income<=0' WHEN equity <= 0 THEN 'equity<=0'
             WHEN trading_status = 'restricted' THEN 'restricted_trading'
             WHEN operating_cash_flow < 0 AND p1_cfo < 0 THEN 'cfo_negative_2y' ELSE '' END AS hard_reject_reason
      FROM (SELECT *, {means} FROM (SELECT *, {SCORES} FROM {source})))"""


view("fx_fa", sql_scored("fx_metrics"))
view("fx_fa_basis", sql_scored("fx_metrics_basis"))
view("fx_fa_reports", sql_scored("fx_metrics_reports"))


def display_fa(market: Market) -> DataFrame:
    return fa.build_fa(market.companies, market.fin_wide, ON_FIXTURES, snapshot(market))


def signal_fa(market: Market) -> DataFrame:
    return fa.build_fa(market.companies, market.fin_wide, ON_FIXTURES, with_market_cap=False)


@query("join_prior_year", """
SELECT ticker, fiscal_year, revenue, p1_income AS prior1_net_income, p3_revenue AS prior3_revenue FROM fx_reports
""")
def join_prior_year(spark, folder):
    return fa.report_history(Market(spark, folder).fin_wide).select(
        "ticker", "fiscal_year", "revenue", F.col("p1.net_income").alias("prior1_net_income"),
        F.col("p3.revenue").alias("prior3_revenue"))


@query("earnings_stability", "SELECT ticker, fiscal_year, round(earnings_stability, 8) AS earnings_stability FROM fx_reports")
def earnings_stability(spark, folder):
    out = fa.report_history(Market(spark, folder).fin_wide)
    return out.select("ticker", "fiscal_year",
                      F.round(fa.earnings_stability(F.col("recent_incomes")), 8).alias("earnings_stability"))


@query("fa_metrics", f"SELECT ticker, {sql_round(fa.FACTORS, 6)} FROM fx_metrics")
def fa_metrics(spark, folder):
    return display_fa(Market(spark, folder)).select("ticker", *rounded(fa.FACTORS, 6))


@query("fa_factor_scores", f"SELECT ticker, {', '.join(f'{f}_score' for f in fa.FACTORS)} FROM fx_fa")
def fa_factor_scores(spark, folder):
    return display_fa(Market(spark, folder)).select("ticker", *[f"{f}_score" for f in fa.FACTORS])


@query("bucket_score", """
SELECT ticker, date, round(x, 8) AS change, CAST(CASE WHEN x >= 0.25 THEN 100 WHEN x >= 0.15 THEN 75 WHEN x >= 0 THEN 40
       WHEN x < 0 THEN 0 END AS DOUBLE) AS score
FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS x FROM fx_bars)
""")
def bucket_score(spark, folder):
    """Interval rules to scores over every bar's change; the first bar has none."""
    from tapeframe.operators.windows import by_date
    out = Market(spark, folder).bars.withColumn("change", F.col("close") / F.lag("close").over(by_date()) - 1)
    return out.select("ticker", "date", F.round("change", 8).alias("change"),
                      fa.bucket_score("profit_growth", F.col("change")).alias("score"))


@query("safe_divide_cagr", """
SELECT ticker, fiscal_year, round(net_income / nullif(revenue, 0), 8) AS margin,
       round(CASE WHEN revenue > 0 AND p3_revenue > 0 THEN pow(revenue / p3_revenue, 1.0 / 3) - 1 END, 8) AS revenue_cagr,
       round(CASE WHEN eps > 0 AND p3_eps > 0 THEN pow(eps / p3_eps, 1.0 / 3) - 1 END, 8) AS eps_cagr FROM fx_reports
""")
def safe_divide_cagr(spark, folder):
    from tapeframe.functions.numeric import cagr, safe_divide
    out = fa.report_history(Market(spark, folder).fin_wide)
    return out.select(
        "ticker", "fiscal_year", F.round(safe_divide(F.col("net_income"), F.col("revenue")), 8).alias("margin"),
        F.round(cagr(F.col("revenue"), F.col("p3.revenue"), 3), 8).alias("revenue_cagr"),
        F.round(cagr(F.col("eps"), F.col("p3.eps"), 3), 8).alias("eps_cagr"))


FA_OUT = ["quality_score", "growth_score", "value_score", "safety_score", "fa_score", "fa_coverage"]


@query("row_mean_skipna", f"""
SELECT ticker, {sql_round([g + s for g in fa.GROUPS for s in ('_score', '_coverage')], 6)} FROM fx_fa
""")
def row_mean_skipna(spark, folder):
    return display_fa(Market(spark, folder)).select(
        "ticker", *rounded([g + s for g in fa.GROUPS for s in ("_score", "_coverage")], 6))


@query("fa_score", f"SELECT ticker, {sql_round(FA_OUT, 6)}, fa_status, fa_pass, hard_reject_reason FROM fx_fa")
def fa_score(spark, folder):
    return display_fa(Market(spark, folder)).select(
        "ticker", *rounded(FA_OUT, 6), "fa_status", "fa_pass", "hard_reject_reason")


@query("fa_signal_basis", f"SELECT ticker, {sql_round(FA_OUT, 6)}, fa_status, fa_pass, hard_reject_reason FROM fx_fa_basis")
def fa_signal_basis(spark, folder):
    return signal_fa(Market(spark, folder)).select(
        "ticker", *rounded(FA_OUT, 6), "fa_status", "fa_pass", "hard_reject_reason")


@query("restricted_status", "SELECT ticker, trading_status = 'restricted' AS restricted FROM fx_companies")
def restricted_status(spark, folder):
    return Market(spark, folder).companies.select(
        "ticker", F.lower("trading_status").rlike(fa.RESTRICTED).alias("restricted"))


@query("sector_relative_value", """
SELECT ticker, sector, round(pe + 1e-9, 6) AS pe, round(sector_relative_value + 1e-9, 6) AS sector_relative_value FROM fx_metrics
""")
def sector_relative_value(spark, folder):
    return display_fa(Market(spark, folder)).select(
        "ticker", "sector", *rounded(["pe", "sector_relative_value"], 6))


view("fx_panel", """
SELECT *, NOT rejected AS fa_eligible, CASE WHEN rejected THEN 0.0 ELSE 50 + (fa_score - 50) * fa_coverage END AS effective_fa,
       CAST(cutoff + INTERVAL 90 DAY AS DATE) AS effective_date
FROM (SELECT c.ticker, k.cutoff, r.fa_score, coalesce(r.fa_coverage, 0) AS fa_coverage,
        coalesce(r.hard_reject_reason, CASE WHEN c.trading_status = 'restricted' THEN 'restricted_trading' ELSE '' END) AS reason,
        coalesce(r.hard_reject_reason, CASE WHEN c.trading_status = 'restricted' THEN 'restricted_trading' ELSE '' END) <> '' AS rejected
      FROM fx_companies c CROSS JOIN (SELECT DISTINCT period_end AS cutoff FROM fx_fin_wide) k
      ASOF LEFT JOIN fx_fa_reports r ON r.ticker = c.ticker AND k.cutoff >= r.period_end)
""")
view("fx_asof_fa", """
SELECT b.ticker, b.date, a.effective_fa, coalesce(e.fa_eligible, false) AS fa_eligible
FROM fx_bars b
ASOF LEFT JOIN (SELECT * FROM fx_panel WHERE effective_fa IS NOT NULL) a ON a.ticker = b.ticker AND b.date >= a.effective_date
ASOF LEFT JOIN fx_panel e ON e.ticker = b.ticker AND b.date >= e.effective_date
""")


@query("fa_panel", """
SELECT ticker, cutoff, effective_date, round(fa_score + 1e-9, 6) AS fa_score, round(fa_coverage + 1e-9, 6) AS fa_coverage,
       round(effective_fa + 1e-9, 6) AS effective_fa, fa_eligible, reason AS hard_reject_reason FROM fx_panel
""")
def fa_panel(spark, folder):
    market = Market(spark, folder)
    return fa.fa_panel(market.companies, market.fin_wide, ON_FIXTURES).select(
        "ticker", "cutoff", "effective_date", *rounded(["fa_score", "fa_coverage", "effective_fa"], 6),
        "fa_eligible", "hard_reject_reason")


@query("theta_report_cutoff", """
SELECT c.ticker, k.cutoff, count(r.period_end) AS reports, max(r.period_end) AS newest
FROM (SELECT DISTINCT ticker FROM fx_fin_wide) c CROSS JOIN (SELECT DISTINCT period_end AS cutoff FROM fx_fin_wide) k
LEFT JOIN fx_fin_wide r ON r.ticker = c.ticker AND r.period_end <= k.cutoff GROUP BY c.ticker, k.cutoff
""")
def theta_report_cutoff(spark, folder):
    """Reports known at every cutoff: running totals along each ticker's cutoffs, no pairs."""
    from pyspark.sql import Window
    annual = Market(spark, folder).fin_wide.select("ticker", "period_end")
    cutoffs = annual.agg(F.array_sort(F.collect_set("period_end")).alias("all"))
    grid = annual.select("ticker").distinct().select("ticker", F.explode(cutoffs.scalar()).alias("cutoff"))
    counts = annual.groupBy("ticker", F.col("period_end").alias("cutoff")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("ticker").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counts, ["ticker", "cutoff"], "left").select(
        "ticker", "cutoff", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("reports"),
        F.max(F.when(F.col("n") > 0, F.col("cutoff"))).over(upto).alias("newest"))


@query("asof_fa", "SELECT ticker, date, round(effective_fa + 1e-9, 6) AS effective_fa, fa_eligible FROM fx_asof_fa")
def asof_fa(spark, folder):
    market = Market(spark, folder)
    panel = fa.fa_panel(market.companies, market.fin_wide, ON_FIXTURES)
    out = fa.asof_fa(panel, market.bars.select("ticker", "date"))
    return out.select("ticker", "date", *rounded(["effective_fa"], 6), "fa_eligible")


def peer_values(market: Market) -> DataFrame:
    """Usable P/E per ticker: the provider's if positive, else market cap over trailing income; at most 200."""
    own = F.when(F.col("pe") > 0, F.col("pe")).otherwise(
        F.when((F.col("market_cap") > 0) & (F.col("net_income_ttm") > 0),
               F.try_divide("market_cap", "net_income_ttm")))
    joined = market.companies.select("ticker", "sector", "industry").join(
        snapshot(market).select("ticker", "pe", "market_cap", "net_income_ttm"), "ticker")
    return joined.withColumn("own_pe", own).withColumn(
        "peer_pe", F.when((F.col("own_pe") > 0) & (F.col("own_pe") <= 200), F.col("own_pe")))


def peer_medians(market: Market) -> DataFrame:
    """Median peer P/E of every company; the industry stands in for sectors with under five peers."""
    values = peer_values(market)

    def level(name: str) -> DataFrame:
        sizes = values.groupBy(name).agg(F.count("*").alias(f"{name}_rows"), F.count("peer_pe").alias(f"{name}_peers"))
        return sizes.join(grouped_median(values, [name], "peer_pe", f"{name}_median"), name, "left")

    base = market.companies.select("ticker", "sector", "industry")
    out = base.join(level("sector"), "sector", "left").join(level("industry"), "industry", "left")
    wide = (F.coalesce(F.col("sector_rows"), F.lit(0)) >= 5) | F.col("industry").isNull()
    pick = lambda a, b: F.when(wide, a).otherwise(b)
    return out.select(
        "ticker", pick(F.lit("sector"), F.lit("industry")).alias("classification_field"),
        pick(F.col("sector"), F.col("industry")).alias("classification"),
        F.coalesce(pick(F.col("sector_peers"), F.col("industry_peers")), F.lit(0)).alias("peer_count"),
        pick(F.col("sector_median"), F.col("industry_median")).alias("median_pe"))


view("fx_peer_values", """
SELECT ticker, sector, industry, CASE WHEN v > 0 AND v <= 200 THEN v END AS peer_pe, v AS own_pe
FROM (SELECT c.ticker, c.sector, c.industry, CASE WHEN s.pe > 0 THEN s.pe WHEN s.market_cap > 0 AND s.net_income_ttm > 0
             THEN s.market_cap / s.net_income_ttm END AS v FROM fx_companies c JOIN fx_snapshot s ON s.ticker = c.ticker)
""")
view("fx_peers", """
SELECT c.ticker, CASE WHEN coalesce(s.n, 0) >= 5 THEN 'sector' ELSE 'industry' END AS classification_field,
       CASE WHEN coalesce(s.n, 0) >= 5 THEN c.sector ELSE c.industry END AS classification,
       CASE WHEN coalesce(s.n, 0) >= 5 THEN s.peers ELSE coalesce(i.peers, 0) END AS peer_count,
       CASE WHEN coalesce(s.n, 0) >= 5 THEN s.m ELSE i.m END AS median_pe
FROM fx_companies c
LEFT JOIN (SELECT sector, count(*) AS n, count(peer_pe) AS peers, median(peer_pe) AS m FROM fx_peer_values GROUP BY sector) s
  ON s.sector = c.sector
LEFT JOIN (SELECT industry, count(*) AS n, count(peer_pe) AS peers, median(peer_pe) AS m FROM fx_peer_values GROUP BY industry) i
  ON i.industry = c.industry
""")


@query("peer_median_pe", """
SELECT ticker, classification_field, classification, peer_count, round(median_pe, 6) AS median_pe FROM fx_peers
""")
def peer_median_pe(spark, folder):
    return peer_medians(Market(spark, folder)).withColumn("median_pe", F.round("median_pe", 6))


@query("pe_vs_peers", """
SELECT p.ticker, round(v.own_pe + 1e-9, 6) AS own_pe, round(p.median_pe + 1e-9, 6) AS median_pe,
       round(v.own_pe / nullif(p.median_pe, 0) - 1, 6) AS difference
FROM fx_peers p LEFT JOIN fx_peer_values v ON v.ticker = p.ticker
""")
def pe_vs_peers(spark, folder):
    market = Market(spark, folder)
    own = peer_values(market).select("ticker", "own_pe")
    return peer_medians(market).join(own, "ticker", "left").select(
        "ticker", *rounded(["own_pe", "median_pe"], 6),
        F.round(F.try_divide("own_pe", "median_pe") - 1, 6).alias("difference"))
