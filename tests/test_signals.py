"""Price/volume features, fundamentals and the decision rules on hand-made frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import asof, fundamentals as fa, signals as sg, windows as w
from tapeframe.params import ACTIVE

DAY = dt.date


def business_days(start, n):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def ramp(spark):
    dates = business_days(DAY(2024, 1, 2), 300)
    close = [100.0 + 100.0 * i / 299 for i in range(300)]
    close[-1] = 220.0
    volume = [1000.0] * 299 + [2000.0]
    bars = spark.createDataFrame([("AAA", d, c, v, c * v) for d, c, v in zip(dates, close, volume)],
                                 "ticker string, date date, close double, volume double, trading_value double")
    index = spark.createDataFrame([(d, 1000.0 + 50.0 * i / 299) for i, d in enumerate(dates)], "date date, close double")
    return bars, index, dates


def test_calendar_return_uses_common_previous_date(spark):
    dates = [DAY(2025, 1, 29), DAY(2025, 4, 29), DAY(2025, 4, 30)]
    panel = spark.createDataFrame([("AAA", d, p, b, True) for d, p, b in zip(dates, (100.0, 119.0, 120.0), (1000.0, 1040.0, 1050.0))],
                                  "ticker string, date date, px double, bm_px double, is_session boolean")
    row = asof.calendar_returns(panel, (3,)).filter(F.col("date") == dates[-1]).first()
    assert row["r3"] == pytest.approx(0.20)


def test_breakout_and_volume_use_the_previous_twenty_bars(ramp):
    bars, index, _ = ramp
    row = sg.ta_latest(bars, index, ACTIVE.with_(minimum_volume_ratio=1.5)).first()
    assert row["avg_vol20"] == pytest.approx(1000.0)
    assert row["volume_ratio"] == pytest.approx(2.0)
    assert row["breakout_pass"] and row["buy_pass"] and row["ta_status"] == "READY"


def test_latest_features_equal_the_last_row_of_history(ramp):
    bars, index, dates = ramp
    last = sg.ta_history(bars, index).filter(F.col("date") == dates[-1]).first()
    live = sg.ta_latest(bars, index, ACTIVE).first()
    for a, b in (("r3", "r_3m"), ("r6", "r_6m"), ("r12", "r_12m"), ("rs6", "rs_6m"), ("ma50", "ma50"), ("ma200", "ma200"),
                 ("high_close60", "high_close60"), ("avg_trading_value20", "avg_trading_value_20d")):
        assert last[a] == pytest.approx(live[b])


def test_history_cannot_see_the_future(spark, ramp):
    bars, index, dates = ramp
    cut = dates[250]
    whole = sg.ta_history(bars.withColumn("close", F.when(F.col("date") > cut, F.col("close") * 10).otherwise(F.col("close"))), index)
    prefix = sg.ta_history(bars.filter(F.col("date") <= cut), index.filter(F.col("date") <= cut))
    keep = ["date", "px", "r3", "r6", "rs6", "ma20", "ma200", "high_close60", "volume_ratio", "volatility20"]
    assert whole.filter(F.col("date") <= cut).select(*keep).orderBy("date").collect() == prefix.select(*keep).orderBy("date").collect()


def test_live_averages_skip_missing_values_and_history_does_not(ramp):
    bars, index, dates = ramp
    holed = bars.withColumn("close", F.when(F.col("date") != dates[295], F.col("close")))
    assert sg.ta_latest(holed, index, ACTIVE).first()["ma20"] is not None
    assert sg.ta_history(holed, index).filter(F.col("date") == dates[-1]).first()["ma20"] is None


def test_stale_price_is_never_bought(spark, ramp):
    bars, index, dates = ramp
    later = index.unionByName(spark.createDataFrame([(dates[-1] + dt.timedelta(days=1), 1200.0)], "date date, close double"))
    ta = sg.ta_latest(bars.withColumn("volume", F.lit(1e6)).withColumn("trading_value", F.col("close") * 1e8), later, ACTIVE)
    fa_row = spark.createDataFrame([("AAA", 80.0, 1.0, "", "READY")],
                                   "ticker string, fa_score double, fa_coverage double, hard_reject_reason string, fa_status string")
    row = sg.build_signals(fa_row, ta, ACTIVE).first()
    assert not row["price_fresh"] and row["final_action"] == "WATCH" and row["watch_reason"] == "STALE_PRICE"


def statements(spark):
    rows = []
    for ticker, years in (("AAA", (2022, 2024, 2025)), ("BBB", (2020, 2021, 2023, 2025))):
        for year in years:
            new = year == 2025
            rows.append((ticker, year, DAY(year, 12, 31), 200.0 if new else 100.0, 20.0 if new else 10.0, 100.0, 200.0, 20.0))
    frame = spark.createDataFrame(rows, "ticker string, fiscal_year long, period_end date, revenue double, net_income double, "
                                        "equity double, total_assets double, operating_cash_flow double")
    missing = ("gross_profit ebit interest_expense profit_before_tax eps total_liabilities cash_and_cash_equivalents current_assets "
               "current_liabilities short_term_borrowings long_term_borrowings depreciation amortization").split()
    return frame.withColumns({n: F.lit(None).cast("double") for n in missing})


def test_fundamentals_use_exact_years_and_invent_no_debt(spark):
    companies = spark.createDataFrame([("AAA", "x", None, "normal"), ("BBB", "x", None, "normal")],
                                      "ticker string, sector string, market_cap double, trading_status string")
    rows = {r["ticker"]: r for r in fa.build_fa(companies, statements(spark), ACTIVE).collect()}
    assert rows["AAA"]["revenue_cagr_3y"] == pytest.approx(2 ** (1 / 3) - 1)
    assert rows["AAA"]["profit_growth"] == pytest.approx(1)
    assert rows["AAA"]["roe"] == pytest.approx(.2)
    assert rows["BBB"]["revenue_cagr_3y"] is None and rows["BBB"]["profit_growth"] is None
    assert rows["AAA"]["debt_equity"] is None and rows["BBB"]["debt_equity"] is None


def test_signal_basis_ignores_market_cap(spark):
    schema = "ticker string, sector string, market_cap double, trading_status string"
    cheap = spark.createDataFrame([("AAA", "x", 1.0, "normal")], schema)
    dear = spark.createDataFrame([("AAA", "x", 1e15, "normal")], schema)
    one, two = (fa.build_fa(c, statements(spark), ACTIVE, with_market_cap=False).select("fa_score", "fa_coverage").first() for c in (cheap, dear))
    assert one == two


def test_restricted_company_is_rejected_before_any_report(spark):
    companies = spark.createDataFrame([("AAA", "x", None, "normal"), ("CCC", "x", None, "Bị đình chỉ")],
                                      "ticker string, sector string, market_cap double, trading_status string")
    panel = fa.fa_panel(companies, statements(spark).filter("ticker = 'AAA'"), ACTIVE)
    assert {r["fa_eligible"] for r in panel.filter("ticker = 'CCC'").collect()} == {False}
    first = panel.filter("ticker = 'AAA'").orderBy("cutoff").first()
    assert first["effective_date"] == DAY(2022, 12, 31) + dt.timedelta(days=90)


def test_indicators(spark):
    line = spark.createDataFrame([("A", DAY(2025, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(20)],
                                 "ticker string, date date, close double")
    assert w.rsi_wilder(line, "close").orderBy(F.desc("date")).first()["rsi"] == 100
    assert w.rsi_wilder(line.withColumn("close", F.lit(5.0)), "close").first()["rsi"] == 50
    short = line.filter("close BETWEEN 1 AND 4")
    assert w.moving_averages(short, "close", (2,)).orderBy(F.desc("date")).first()["ma2"] == 3.5


def test_strength_index_in_blocks_equals_the_recurrence(spark):
    from tapeframe.operators.windows import rsi_wilder
    rng = random.Random(5)
    closes, px = {}, 50.0
    for ticker, n in (("A", 300), ("B", 15), ("C", 14), ("FLAT", 60), ("UP", 60), ("QUIET", 300)):
        px, row = 50.0, []
        for i in range(n):
            px += 0 if ticker == "FLAT" or (ticker == "QUIET" and i > 40) else abs(rng.gauss(0, 1)) if ticker == "UP" else rng.gauss(0, 1)
            row.append(px)
        closes[ticker] = row
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), c) for t, row in closes.items() for i, c in enumerate(row)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(5)
    want = {}
    for t, row in closes.items():
        moves = [b - a for a, b in zip(row, row[1:])]
        if len(moves) < 14:
            continue
        gain, loss = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
        for i in range(14, len(row)):
            if i > 14:
                gain, loss = (gain * 13 + max(moves[i - 1], 0)) / 14, (loss * 13 + max(-moves[i - 1], 0)) / 14
            want[(t, i)] = (50.0 if gain == 0 else 100.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
    for block in (8, 512):
        frame = rsi_wilder(bars, "close", block=block)
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
        got = {(r.ticker, (r.date - dt.date(2020, 1, 1)).days): r.rsi for r in frame.collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-7
