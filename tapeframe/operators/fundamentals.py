"""Annual statements to factor metrics, scores and a point-in-time panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions.numeric import cagr, first_match, is_true, safe_divide
from tapeframe.operators.ranking import first_per_key, grouped_median
from tapeframe.params import Strategy
from tapeframe.runtime import stage

# Which factors make up each score group.
GROUPS = {
    "quality": ["roe", "roa", "roic", "profit_margin", "cash_flow_quality", "earnings_stability"],
    "growth": ["revenue_cagr_3y", "eps_cagr_3y", "profit_growth", "margin_expansion_3y"],
    "value": ["pe", "pb", "earnings_yield", "ev_ebitda", "sector_relative_value"],
    "safety": ["debt_equity", "net_debt_ebitda", "interest_coverage", "current_ratio"],
}
FACTORS = [f for names in GROUPS.values() for f in names]

# Score tables.  "floors" are read as "at least", "caps" as "at most",
# top to bottom; the last number is the score when none holds.
FLOORS = {
    "roe": ([(.20, 100), (.15, 80), (.10, 50)], 0),
    "roa": ([(.10, 100), (.07, 75), (.05, 50)], 0),
    "roic": ([(.15, 100), (.10, 70)], 20),
    "profit_margin": ([(.15, 100), (.10, 75), (.05, 40)], 0),
    "revenue_cagr_3y": ([(.20, 100), (.12, 75), (.05, 40)], 0),
    "eps_cagr_3y": ([(.20, 100), (.12, 75), (.05, 40)], 0),
    "profit_growth": ([(.25, 100), (.15, 75), (0, 40)], 0),
    "earnings_yield": ([(.10, 100), (.065, 70)], 20),
    "interest_coverage": ([(5, 100), (3, 70), (1.5, 30)], 0),
    "current_ratio": ([(1.5, 100), (1, 60)], 0),
}
CAPS = {
    "earnings_stability": ([(.2, 100), (.5, 60)], 20),
    "pe": ([(10, 100), (15, 75), (22, 40)], 0),
    "pb": ([(1.2, 100), (2, 70), (3.5, 30)], 0),
    "ev_ebitda": ([(6, 100), (10, 70)], 20),
    "sector_relative_value": ([(.8, 100), (1, 75), (1.2, 40)], 20),
    "debt_equity": ([(.5, 100), (1, 75), (2, 40)], 0),
    "net_debt_ebitda": ([(1.5, 100), (3, 60)], 0),
}
POSITIVE_ONLY = ("pe", "pb")
RESTRICTED = "hạn chế|đình chỉ|restricted|suspend|control"


def bucket_score(name: str, x: Column | None = None) -> Column:
    """Score of one factor; a missing factor has no score."""
    x = F.col(name) if x is None else x
    if name in FLOORS:
        steps, rest = FLOORS[name]
        rules = [(x >= limit, float(score)) for limit, score in steps]
    elif name in CAPS:
        steps, rest = CAPS[name]
        rules = [(x <= limit, float(score)) for limit, score in steps]
        if name in POSITIVE_ONLY:
            rules.insert(0, (x <= 0, 0.0))
    elif name == "cash_flow_quality":
        rules, rest = [(x >= 1, 100.0), (x >= .7, 70.0), (x > 0, 30.0)], 0
    elif name == "margin_expansion_3y":
        rules, rest = [(x > .02, 100.0), (x >= 0, 60.0)], 0
    else:
        raise KeyError(name)
    return F.when(x.isNotNull(), first_match(rules, float(rest)))


def report_history(annual: DataFrame, years=(1, 3)) -> DataFrame:
    """Each report next to the reports exactly k fiscal years earlier.

    A range frame on the fiscal year finds the earlier row without a self-join; a
    missing year finds nothing.  A ticker's reports are one row per year.
    """
    annual = first_per_key(annual, ["ticker", "fiscal_year"], [F.col("period_end").desc()])
    values = [c for c in annual.columns if c not in ("ticker", "fiscal_year")]
    out = annual
    for k in years:
        earlier = Window.partitionBy("ticker").orderBy("fiscal_year").rangeBetween(-k, -k)
        out = out.withColumn(f"p{k}", F.last(F.struct(*values)).over(earlier))
    upto = Window.partitionBy("ticker").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0)
    incomes = F.collect_list("net_income").over(upto)
    recent = F.slice(incomes, F.greatest(F.size(incomes) - 4, F.lit(1)), 5)
    return out.withColumn("recent_incomes", recent)


def earnings_stability(recent: Column) -> Column:
    """Population deviation over the absolute mean of at most five incomes, at least three."""
    n = F.size(recent)
    mean = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(recent, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when(n >= 3, safe_divide(spread, F.abs(mean)))


def latest_reports(history: DataFrame) -> DataFrame:
    return first_per_key(history, ["ticker"], [F.col("period_end").desc()])


def metrics(reports: DataFrame) -> DataFrame:
    """The ratios of each report row of ``report_history``.

    Expects market_cap, snapshot_pe and snapshot_pb (null where unknown) and sector.
    Any missing operand leaves a ratio missing.
    """
    c = F.col
    average = lambda name: (c(name) + c(f"p1.{name}")) / 2
    debt = c("short_term_borrowings") + c("long_term_borrowings")
    built_up = c("ebit") + c("depreciation") + c("amortization")
    ebitda = F.coalesce(c("is_ebitda"), built_up) if "is_ebitda" in reports.columns else built_up
    rate = safe_divide(c("profit_before_tax") - c("net_income"), c("profit_before_tax"))
    tax = F.when(rate.isNull(), .20).otherwise(F.least(F.greatest(rate, F.lit(0.0)), F.lit(.35)))
    net_debt = debt - c("cash_and_cash_equivalents")
    return reports.withColumns({
        "roe": safe_divide(c("net_income"), average("equity")),
        "roa": safe_divide(c("net_income"), average("total_assets")),
        "roic": safe_divide(c("ebit") * (1 - tax), c("equity") + debt - c("cash_and_cash_equivalents")),
        "profit_margin": safe_divide(c("net_income"), c("revenue")),
        "cash_flow_quality": safe_divide(c("operating_cash_flow"), c("net_income")),
        "revenue_cagr_3y": cagr(c("revenue"), c("p3.revenue"), 3),
        "eps_cagr_3y": cagr(c("eps"), c("p3.eps"), 3),
        "profit_growth": safe_divide(c("net_income"), c("p1.net_income")) - 1,
        "margin_expansion_3y": safe_divide(c("gross_profit"), c("revenue"))
        - safe_divide(c("p3.gross_profit"), c("p3.revenue")),
        "debt_equity": safe_divide(debt, c("equity")),
        "net_debt_ebitda": safe_divide(net_debt, ebitda),
        "interest_coverage": safe_divide(c("ebit"), F.abs(c("interest_expense"))),
        "current_ratio": safe_divide(c("current_assets"), c("current_liabilities")),
        "earnings_stability": earnings_stability(c("recent_incomes")),
        "earnings_yield": safe_divide(c("net_income"), c("market_cap")),
        "pe": F.coalesce(c("snapshot_pe"), safe_divide(c("market_cap"), c("net_income"))),
        "pb": F.coalesce(c("snapshot_pb"), safe_divide(c("market_cap"), c("equity"))),
        "ev_ebitda": safe_divide(c("market_cap") + net_debt, ebitda),
    })


def with_sector_value(frame: DataFrame) -> DataFrame:
    """P/E relative to the median positive P/E of the sector."""
    medians = grouped_median(frame.select("sector", "pe"), ["sector"], "pe", "_sector_pe")
    return frame.join(medians, "sector", "left").withColumn(
        "sector_relative_value", safe_divide(F.col("pe"), F.col("_sector_pe"))).drop("_sector_pe")


def with_scores(frame: DataFrame) -> DataFrame:
    return frame.withColumns({f"{f}_score": bucket_score(f) for f in FACTORS})


def mean_present(columns: list[str]) -> Column:
    """Mean over the non-null values of a row; null when there are none."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0,
                  F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def share_present(columns: list[str]) -> Column:
    return F.size(F.filter(F.array(*columns), lambda x: x.isNotNull())) / F.lit(float(len(columns)))


def with_fa_score(frame: DataFrame, strategy: Strategy) -> DataFrame:
    """Group means, weighted over the groups that have one, coverage, reject reason and status."""
    parts = {}
    for group, names in GROUPS.items():
        columns = [f"{n}_score" for n in names]
        parts[f"{group}_score"] = mean_present(columns)
        parts[f"{group}_coverage"] = share_present(columns)
    out = frame.withColumns(parts)
    weighted = sum((F.coalesce(F.col(f"{g}_score"), F.lit(0.0)) * w for g, w in strategy.group_weights.items()),
                   F.lit(0.0))
    available = sum((F.when(F.col(f"{g}_score").isNotNull(), w).otherwise(0.0)
                     for g, w in strategy.group_weights.items()), F.lit(0.0))
    coverage = sum((F.col(f"{g}_coverage") * w for g, w in strategy.group_weights.items()), F.lit(0.0))
    restricted = is_true(F.lower("trading_status").rlike(RESTRICTED))
    losing_cash = is_true((F.col("operating_cash_flow") < 0) & (F.col("p1.operating_cash_flow") < 0))
    reason = first_match([
        (is_true(F.col("net_income") <= 0), "net_income<=0"),
        (is_true(F.col("equity") <= 0), "equity<=0"),
        (restricted, "restricted_trading"),
        (losing_cash, "cfo_negative_2y"),
    ], "")
    out = out.withColumns({"fa_score": F.try_divide(weighted, available), "fa_coverage": coverage,
                           "hard_reject_reason": reason})
    ready = F.col("fa_coverage") >= strategy.minimum_fa_coverage
    return out.withColumns({
        "fa_status": F.when(ready, "READY").otherwise("INSUFFICIENT_DATA"),
        "fa_pass": is_true(ready & (F.col("fa_score") >= strategy.buy_fa_score) & (F.col("hard_reject_reason") == "")),
    })


def build_fa(companies: DataFrame, annual: DataFrame, strategy: Strategy,
             snapshot: DataFrame | None = None, with_market_cap: bool = True) -> DataFrame:
    """One scored row per company.

    The signal basis leaves out market cap and snapshot, because history has neither.
    """
    latest = latest_reports(report_history(annual))
    base = companies if with_market_cap else companies.withColumn("market_cap", F.lit(None).cast("double"))
    if snapshot is not None:
        newest = first_per_key(snapshot, ["ticker"], [F.col("as_of_utc").desc()])
        base = base.drop("market_cap").join(
            newest.select("ticker", "market_cap", F.col("pe").alias("snapshot_pe"), F.col("pb").alias("snapshot_pb")),
            "ticker", "left")
    else:
        base = base.withColumns({"snapshot_pe": F.lit(None).cast("double"), "snapshot_pb": F.lit(None).cast("double")})
    rows = metrics(base.join(latest, "ticker", "left"))
    rows = with_sector_value(rows) if with_market_cap else rows.withColumn(
        "sector_relative_value", F.lit(None).cast("double"))
    return with_fa_score(with_scores(rows), strategy)


def effective_fa(score: Column, coverage: Column, rejected: Column) -> Column:
    """Shrink toward 50 where coverage is thin; a rejected company scores 0."""
    clipped = F.least(F.greatest(F.coalesce(coverage, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(rejected, 0.0).otherwise(50.0 + (score - 50.0) * clipped)


def scored_reports(companies: DataFrame, annual: DataFrame, strategy: Strategy) -> DataFrame:
    """The score every report had when it was the newest one; no market data enters."""
    base = companies.select("ticker", "sector", "trading_status")
    nulls = {n: F.lit(None).cast("double") for n in ("market_cap", "snapshot_pe", "snapshot_pb")}
    rows = metrics(report_history(annual).join(base, "ticker").withColumns(nulls))
    rows = rows.withColumn("sector_relative_value", F.lit(None).cast("double"))
    return with_fa_score(with_scores(rows), strategy)


def fa_panel(companies: DataFrame, annual: DataFrame, strategy: Strategy, lag_days: int | None = None) -> DataFrame:
    """Score of every company at every report cutoff, usable from cutoff plus the reporting lag.

    Only a company's own reports change its score, so each report is scored once and
    carried to the later cutoffs; reports and cutoffs are never paired.
    """
    lag_days = strategy.reporting_lag_days if lag_days is None else lag_days
    annual = stage(annual, "annual")  # read twice
    scored = scored_reports(companies, annual, strategy).select(
        "ticker", F.col("period_end").alias("cutoff"),
        F.struct("fa_score", "fa_coverage", "hard_reject_reason").alias("_s"))
    # The cutoffs are one value per fiscal year end: a short list by nature.
    cutoffs = annual.filter(F.col("period_end").isNotNull()).agg(
        F.array_sort(F.collect_set("period_end")).alias("_all"))
    grid = companies.select("ticker", "trading_status", F.explode(cutoffs.scalar()).alias("cutoff"))
    carry = Window.partitionBy("ticker").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    panel = grid.join(scored, ["ticker", "cutoff"], "left").withColumn(
        "_s", F.last("_s", ignorenulls=True).over(carry))
    before_any = F.when(is_true(F.lower("trading_status").rlike(RESTRICTED)), "restricted_trading").otherwise("")
    panel = panel.select(
        "ticker", "cutoff", F.col("_s.fa_score").alias("fa_score"),
        F.coalesce(F.col("_s.fa_coverage"), F.lit(0.0)).alias("fa_coverage"),
        F.coalesce(F.col("_s.hard_reject_reason"), before_any).alias("hard_reject_reason"))
    rejected = F.col("hard_reject_reason") != ""
    return panel.withColumns({
        "effective_fa": effective_fa(F.col("fa_score"), F.col("fa_coverage"), rejected),
        "fa_eligible": ~rejected,
        "effective_date": F.date_add("cutoff", lag_days)})


def asof_fa(panel: DataFrame, sessions: DataFrame) -> DataFrame:
    """For every (ticker, date) the newest usable score and eligibility.

    Before the first usable score there is none; before the first cutoff a company
    is not eligible.
    """
    events = sessions.withColumns({"_side": F.lit(1)}).unionByName(
        panel.select("ticker", F.col("effective_date").alias("date"), F.lit(0).alias("_side"),
                     F.col("effective_fa").alias("_fa"), F.col("fa_eligible").alias("_ok")),
        allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({"effective_fa": F.last("_fa", ignorenulls=True).over(w),
                              "fa_eligible": F.coalesce(F.last("_ok", ignorenulls=True).over(w), F.lit(False))})
    return out.filter("_side = 1").drop("_side", "_fa", "_ok")
