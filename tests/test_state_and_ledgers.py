"""Portfolio state machine, ledgers, evaluation and text rules."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeframe.functions import cleaning as c
from tapeframe.operators import clean, ledger as lg, portfolio as pf, prices as px, research as rs, textmatch as tm
from tapeframe.operators.ranking import first_per_key, global_row_number, grouped_median
from tapeframe.params import ACTIVE
from tapeframe.streaming import jobs

DAY = dt.date
STRATEGY = ACTIVE.with_(max_positions=1)


def signal_rows(spark, score_a=80.0, score_b=70.0, risk_a=False, score_exit_a=False, fresh_a=True):
    rows = [("AAA", score_a, 2.0, fresh_a, score_a >= 60, risk_a, score_exit_a), ("BBB", score_b, 1.0, True, score_b >= 60, False, False)]
    out = spark.createDataFrame(rows, "ticker string, unified_score double, selection_strength double, price_fresh boolean, "
                                      "entry_eligible boolean, exit_risk_trigger boolean, exit_score_trigger boolean")
    return out.withColumns({
        "ta_ready": F.lit(True), "has_exit_data": F.lit(True), "exit_ma_trigger": F.col("exit_risk_trigger"), "price": F.lit(10.0),
        "volume": F.lit(5.0), "exit_trailing_trigger": F.lit(False), "exit_market_trigger": F.lit(False), "watch_reason": F.lit("NONE"),
        "final_action": F.when(F.col("entry_eligible"), "BUY").otherwise("WATCH")})


def run_day(spark, state, signals, last, today, sessions):
    calendar = spark.createDataFrame([(d,) for d in sessions], "date date")
    positions = spark.createDataFrame(state.get("positions", []), "ticker string, entry_signal_date date, entry_date date, holding_sessions long")
    pending = spark.createDataFrame(state.get("pending", []), "ticker string, side string, signal_date date")
    cooldowns = spark.createDataFrame(state.get("cooldowns", []), "ticker string, remaining_sessions long")
    steps = pf.session_steps(calendar, last, today)
    after = pf.advance(positions, pending, cooldowns, pf.tradable(signals), steps, today, STRATEGY.cooldown_days)
    assigned = pf.assign_actions(signals, after, STRATEGY)
    actions = {r["ticker"]: r for r in assigned.collect()}
    new = {"positions": [tuple([r["ticker"], *r["position"]]) for r in after.filter("position IS NOT NULL").collect()],
           "pending": [(r["ticker"], r["side"], r["signal_date"]) for r in pf.new_orders(assigned, after, today).collect()],
           "cooldowns": [(r["ticker"], r["cooldown"]) for r in after.filter("cooldown IS NOT NULL").collect()]}
    return actions, new


def test_buy_is_pending_then_held_next_session(spark):
    a, state = run_day(spark, {}, signal_rows(spark), None, "2026-09-21", [DAY(2026, 9, 21)])
    assert a["AAA"]["final_action"] == "BUY" and a["BBB"]["watch_reason"] == "NO_FREE_SLOT"
    assert state["pending"] == [("AAA", "BUY", DAY(2026, 9, 21))] and state["positions"] == []
    rerun, again = run_day(spark, state, signal_rows(spark), "2026-09-21", "2026-09-21", [DAY(2026, 9, 21)])
    assert rerun["AAA"]["final_action"] == "BUY" and again["positions"] == []
    a, state = run_day(spark, state, signal_rows(spark), "2026-09-21", "2026-09-22", [DAY(2026, 9, 21), DAY(2026, 9, 22)])
    assert a["AAA"]["final_action"] == "HOLD" and a["AAA"]["screen_action"] == "BUY"
    assert state["positions"][0][3] == 0


def test_risk_exit_is_immediate_and_the_sale_starts_a_cooldown(spark):
    held = {"positions": [("AAA", DAY(2026, 9, 20), DAY(2026, 9, 21), 0)]}
    a, state = run_day(spark, held, signal_rows(spark, risk_a=True), "2026-09-21", "2026-09-22", [DAY(2026, 9, 21), DAY(2026, 9, 22)])
    assert a["AAA"]["final_action"] == "EXIT" and state["pending"][0][:2] == ("AAA", "SELL")
    _, state = run_day(spark, state, signal_rows(spark), "2026-09-22", "2026-09-23", [DAY(2026, 9, d) for d in (21, 22, 23)])
    assert all(p[0] != "AAA" for p in state["positions"]) and ("AAA", 5) in state["cooldowns"]


@pytest.mark.parametrize("age,action", [(7, "HOLD"), (9, "EXIT")])
def test_score_exit_waits_for_the_minimum_holding(spark, age, action):
    held = {"positions": [("AAA", DAY(2026, 9, 1), DAY(2026, 9, 2), age)]}
    a, _ = run_day(spark, held, signal_rows(spark, score_a=30.0, score_exit_a=True), "2026-09-21", "2026-09-22", [DAY(2026, 9, 22)])
    assert a["AAA"]["final_action"] == action and a["AAA"]["exit_score_blocked_by_min_hold"] == (action == "HOLD")


def test_pending_sell_waits_for_a_fresh_quote(spark):
    state = {"positions": [("AAA", DAY(2026, 9, 1), DAY(2026, 9, 2), 12)], "pending": [("AAA", "SELL", DAY(2026, 9, 21))]}
    a, new = run_day(spark, state, signal_rows(spark, fresh_a=False), "2026-09-21", "2026-09-22", [DAY(2026, 9, 22)])
    assert a["AAA"]["final_action"] == "DATA_REVIEW"
    assert new["positions"][0][0] == "AAA" and ("AAA", "SELL", DAY(2026, 9, 21)) in new["pending"]


ORDERS = "id long, account long, side string, ticker string, quantity long, price double, market_date date"


def test_ledger_cash_and_realised_profit(spark):
    orders = spark.createDataFrame([(1, 1, "BUY", "FPT", 5, 99000.0, DAY(2026, 9, 21)), (2, 1, "SELL", "FPT", 2, 99000.0, DAY(2026, 9, 21)),
                                    (3, 1, "SELL", "FPT", 9, 99000.0, DAY(2026, 9, 21)), (4, 1, "BUY", "FPT", 100, 99000.0, DAY(2026, 9, 21))], ORDERS)
    rows = lg.replay(orders, 1_000_000.0).orderBy("id").collect()
    assert [r["status"] for r in rows] == ["ACCEPTED", "ACCEPTED", "OVERSELL", "OVERSPEND"]
    assert rows[0]["cash_after"] == 504257.5
    held = lg.positions(lg.replay(orders, 1_000_000.0).filter("status = 'ACCEPTED'")).first()
    assert held["quantity"] == 3 and held["realized_pnl"] == pytest.approx(-594)


def test_positions_do_not_depend_on_the_slicing(spark):
    rnd, rows, held = random.Random(3), [], 0
    for i in range(400):
        side = "BUY" if held == 0 or rnd.random() < .5 else "SELL"
        n = rnd.randint(1, 9) if side == "BUY" else rnd.randint(1, held)
        held += n if side == "BUY" else -n
        rows.append((i, 1, side, "AAA", n, float(rnd.randint(10, 99)), DAY(2026, 1, 1)))
    trades = lg.with_amounts(spark.createDataFrame(rows, ORDERS))
    basis = profit = quantity = 0.0
    for r in trades.orderBy("id").collect():
        if r["side"] == "BUY":
            basis, quantity = basis + r["gross"] + r["fee"], quantity + r["quantity"]
        else:
            average = basis / quantity
            profit += r["gross"] - r["fee"] - average * r["quantity"]
            quantity -= r["quantity"]
            basis = average * quantity
    for size in (1, 7, 1000):
        got = lg.positions(trades, size).first()
        assert (got["quantity"], got["cost_basis"], got["realized_pnl"]) == (quantity, pytest.approx(basis, abs=1e-6), pytest.approx(profit, abs=1e-6))


def test_quota_window_starts_at_the_first_event(spark):
    events = spark.createDataFrame([(i, 1, at) for i, at in enumerate([100, 110, 120, 159, 160])], "event_id long, subject long, at_s long")
    rows = jobs.run_quota(jobs.feed_of([events], "quota"), 2, 60).orderBy("event_id").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True]
    assert [r.retry_after for r in rows] == [0, 0, 40, 1, 0]


def test_drawdown_starts_from_the_capital_and_statistics_keep_open_trades_apart(spark):
    daily = spark.createDataFrame([(1, DAY(2026, 1, 1), -.1, 0.0, 0), (1, DAY(2026, 1, 2), 0.0, 0.0, 0)], "config int, date date, ret double, turnover double, holdings int")
    assert rs.metrics(daily, ["config"]).first()["maximum_drawdown"] == pytest.approx(-.1)
    trades = spark.createDataFrame([("CLOSED", -.1, -.08), ("OPEN", None, None)], "status string, net_return double, gross_return double")
    row = rs.ledger_statistics(trades).first()
    assert row["max_win_return"] is None and row["open_trade_count"] == 1


def test_trade_statistics_use_previous_closes(spark):
    line = spark.createDataFrame([("AAA", DAY(2026, 1, i + 1), p, h) for i, (p, h) in enumerate(zip((100.0, 110.0, 99.0, 120.0, 130.0, 140.0), (0, 1, 1, 0, 1, 1)))],
                                 "ticker string, date date, px double, held int")
    row = rs.trade_statistics(rs.position_changes(line)).first()
    assert (row["trade_count"], row["open_trade_count"]) == (1, 1)
    assert row["average_trade_return_before_cost"] == pytest.approx(-.01)


def test_ranking_cannot_see_returns_after_the_cutoff(spark):
    rnd = random.Random(8)
    days = [DAY(2019, 1, 1) + dt.timedelta(days=i) for i in range(1200)]
    base = [(k, d, rnd.gauss(.0005, .01), 0.0, 10) for k in range(3) for d in days]
    schema = "config int, date date, ret double, turnover double, holdings int"
    index = spark.createDataFrame([(d, rnd.gauss(.0001, .01), 0.0, 0) for d in days], "date date, ret double, turnover double, holdings int")

    def ranking(rows):
        out = rs.ranked(rs.objective(spark.createDataFrame(rows, schema), index, [2021]))
        return [(r["config"], r["rank"], round(r["objective"], 9)) for r in out.orderBy("rank").collect()]

    changed = [(k, d, .05 * (k + 1) if d >= DAY(2021, 1, 1) else r, t, h) for k, d, r, t, h in base]
    assert ranking(base) == ranking(changed)


def test_turnover_and_breadth_limits_rule_a_configuration_out(spark):
    days = [DAY(2019, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [(0, d, .001, 1.0, 10) for d in days]
    daily = spark.createDataFrame(rows, "config int, date date, ret double, turnover double, holdings int")
    index = daily.select("date", "ret", F.lit(0.0).alias("turnover"), F.lit(0).alias("holdings"))
    assert rs.objective(daily, index, [2020]).first()["objective"] == pytest.approx(-100 - 252)


def test_mixed_action_dates_survive(spark):
    rows = spark.createDataFrame([("AAA", "2026-09-21"), ("AAA", "2026-09-22 00:00:00"), ("AAA", "soon")], "ticker string, d string")
    got = [r[0] for r in rows.select(c.date_prefix(F.col("d"))).collect()]
    assert got == [DAY(2026, 9, 21), DAY(2026, 9, 22), None]


BAR = "ticker string, date date, open double, high double, low double, close double, volume double, source string, source_checksum string"


def test_reconcile_keeps_the_primary_source_checksum(spark):
    primary = spark.createDataFrame([("AAA", DAY(2026, 9, 21), 100.0, 100.0, 100.0, 100.0, 1000.0, "DNSE", "abc")], BAR)
    fallback = spark.createDataFrame([("AAA", DAY(2026, 9, 21), 130.0, 130.0, 130.0, 130.0, 1000.0, "vnstock KBS", None)], BAR)
    row = px.reconcile(primary, fallback).first()
    assert (row["source"], row["source_checksum"], row["origin"]) == ("vnstock KBS", "abc", "replaced")


@pytest.mark.parametrize("source,found", [("vnstock KBS", 0), ("DNSE", 1)])
def test_only_the_source_itself_can_prove_a_restatement(spark, source, found):
    old = clean.with_checksums(spark.createDataFrame([("AAA", DAY(2026, 9, 21), 100.0, 100.0, 100.0, 100.0, 1000.0, source)], BAR.rsplit(",", 1)[0]))
    new = clean.with_checksums(old.drop("row_checksum", "source_checksum").withColumn("close", F.lit(101.0)))
    rows = px.revisions(old, new, "r", "x")
    assert rows.count() == 1 and px.source_restatements(rows).count() == found


def test_company_and_macro_relevance(spark):
    docs = spark.createDataFrame([
        (1, "Tỷ phú trở lại câu lạc bộ USD", "Thị trường quốc tế"), (2, "Vingroup khởi công dự án mới", "Mã VIC"),
        (3, "Giá nhựa thế giới", "Chi phí nguyên liệu sản xuất"), (4, "Nhựa Tiền Phong công bố kết quả", "Doanh thu tăng"),
        (5, "CSHB2619: Chứng quyền SHB/LPBS/Call", "SHB"), (6, "US inflation rises", "Federal Reserve rates"),
        (7, "Lãi suất Việt Nam", "Ngân hàng Nhà nước điều hành tín dụng")], "doc_id long, title string, content string")
    companies = spark.createDataFrame([("VIC", "Vingroup"), ("NTP", "CTCP Nhựa Thiếu niên Tiền Phong"), ("SHB", "Ngân hàng SHB")], "ticker string, company_name string")
    assert {tuple(r) for r in tm.company_match(docs, companies).collect()} == {(2, "VIC"), (4, "NTP")}
    assert [r["doc_id"] for r in tm.macro_match(docs).collect()] == [7]
    name = spark.createDataFrame([("CTCP Tập đoàn Hoa Sen", "Sản xuất")], "n string, i string")
    assert name.select(tm.industry_hint(F.col("n"), F.col("i"))).first()[0] == "ngành thép"


def test_payload_candle_is_in_full_units(spark):
    at = int(dt.datetime(2026, 9, 22, tzinfo=dt.timezone.utc).timestamp())
    body = f'{{"t":[{at}],"o":[66.4],"h":[67.0],"l":[65.5],"c":[66.6],"v":[1234567]}}'
    row = clean.ohlc_payload(spark.createDataFrame([("FPT", body)], "ticker string, payload string")).first()
    assert (row["date"], row["open"], row["close"], row["volume"]) == (DAY(2026, 9, 22), 66400, 66600, 1234567)


def test_median_of_a_hot_group_is_exact(spark):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([1.0, 2.5, rnd.uniform(.1, 200)])) for _ in range(5000)] + [("cold", float(i)) for i in range(1, 8)] + [("none", -1.0)]
    got = {r["g"]: r["median"] for r in grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = pd.DataFrame(rows, columns=["g", "v"]).query("v > 0").groupby("g")["v"].median().to_dict()
    assert got == pytest.approx(want)


def test_global_row_number_counts_every_row_once(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = global_row_number(rows, [F.col("k").asc()], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))


def test_dedupe_prunes_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_key(rows, ["k"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_no_plan_pairs_all_rows(spark):
    from tapeframe.plans import load_all
    from tapeframe.plans.registry import QUERIES
    from tests.conftest import FOLDER
    load_all()
    for name in ("theta_action_adjust", "theta_report_cutoff", "fa_panel", "company_match", "cross_config_panel", "coverage_report"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_reads_only_what_is_used(spark):
    from tapeframe.sources.driver import Market
    from tests.conftest import FOLDER
    plan = Market(spark, FOLDER).bars.select("ticker", "date", "close")._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,0.0)]" in plan


def test_slices_of_a_hot_account_equal_the_walk(spark):
    rng = random.Random(3)
    rows = [(i * 3 + rng.randint(0, 2), 1 if i % 20 else i % 7 + 2, rng.choice(["BUY", "SELL"]), rng.choice(["AA", "BB", "C-C", "DD"]), rng.choice([0, 1, 5, 40]),
             round(rng.uniform(1, 90), 2), None) for i in range(6000)]
    orders = spark.createDataFrame(rows, "id long, account long, side string, ticker string, quantity long, price double, market_date date").repartition(6)
    for cash in (3_000.0, 1e9):
        want = {r.id: r for r in lg.replay(orders, cash).collect()}
        got = lg.replay(orders, cash, chunk=1000).collect()
        assert len(got) == len(rows) and len({r.status for r in got}) >= 4 + (cash < 1e6) - (cash > 1e6)
        assert all(r.status == want[r.id].status and abs(r.cash_after - want[r.id].cash_after) < 1e-6 * max(1, cash) for r in got)


def test_a_million_orders_of_an_account_use_several_tasks(spark):
    orders = spark.range(1_000_000).select("id", F.lit(1).cast("long").alias("account"), F.when(F.col("id") % 3 < 2, "BUY").otherwise("SELL").alias("side"),
                                           F.concat(F.lit("T"), F.col("id") % 5).alias("ticker"), (1 + F.col("id") % 9).alias("quantity"),
                                           (10 + F.col("id") % 17).cast("double").alias("price"), F.lit(None).cast("date").alias("market_date"))
    cut = lg.sliced(orders, 125_000)
    sizes = [r["count"] for r in cut.groupBy("slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 125_000 * 1.25
    done = lg.replay(orders, 1e12, chunk=125_000).groupBy("status").count().collect()
    assert sum(r["count"] for r in done) == 1_000_000


def test_replay_of_no_orders(spark):
    none = spark.createDataFrame([], "id long, account long, side string, ticker string, quantity long, price double, market_date date")
    assert lg.replay(none, 1.0).collect() == [] and lg.replay(none, 1.0, chunk=1).collect() == []
