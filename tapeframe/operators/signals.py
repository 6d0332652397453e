"""Price/volume features, the unified score and the decision of each ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions.numeric import first_match, is_true, safe_divide
from tapeframe.operators import windows as w
from tapeframe.operators.asof import benchmark_panel, calendar_returns, with_index
from tapeframe.operators.fundamentals import effective_fa
from tapeframe.operators.ranking import global_row_number
from tapeframe.params import Strategy
from tapeframe.runtime import stage

FLAGS = {"momentum": "momentum_pass", "relative_strength": "rs_pass", "trend": "trend_pass",
         "breakout": "breakout_pass", "volume": "volume_pass"}
ACTION_ORDER = ("BUY", "HOLD", "WATCH", "DATA_REVIEW", "EXIT")


def ta_history(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every feature at every bar, from the bar's own past only.

    One shuffle, by ticker, for all windows.
    """
    out = bars.select("ticker", "date", F.col("close").alias("px"), "volume", "trading_value")
    out = calendar_returns(with_index(out, benchmark_panel(benchmark, bars)))
    out = out.withColumn("_n_r", safe_divide(F.col("px"), F.lag("px").over(w.by_date())) - 1)
    out = w.with_running_count(out, "px", "volume", "trading_value", "_n_r")
    out = w.with_blocks(out, "px")
    features = {f"ma{n}": F.when(w.all_present("px", n), F.col(f"_n_sum{n}") / n) for n in (20, 50, 100, 200)}
    features |= {f"high_close{n}": F.when(w.all_present("px", n, 1), F.col(f"_n_max{n}")) for n in (20, 60)}
    features["volatility20"] = w.rolling(F.stddev_pop, "_n_r", 20)
    features["_n_avg_volume"] = w.rolling(F.avg, "volume", 20, 1)
    features["avg_trading_value20"] = w.rolling(F.avg, "trading_value", 20, 1)
    out = out.withColumns(features)
    return w.drop_helpers(out.withColumn("volume_ratio", safe_divide(F.col("volume"), F.col("_n_avg_volume"))))


def ta_latest(bars: DataFrame, benchmark: DataFrame, strategy: Strategy) -> DataFrame:
    """The features at each ticker's last priced bar.

    Averages use the last N present values.  Only rows counted back from the end
    matter, so the result is one aggregation over ranked rows and needs no sliding
    frames.
    """
    newest_first = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    running = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    panel = benchmark_panel(benchmark, bars, (strategy.regime_ma,)).select(
        "date", F.when(F.col("is_session"), F.col("bm_px")).alias("bm_px"))
    rows = with_index(bars.select("ticker", "date", F.col("close").alias("px"), "volume", "trading_value"), panel)
    rows = rows.withColumn("_npx", F.count("px").over(running))
    rows = rows.filter("_npx >= 1")
    rows = rows.withColumn("_is_end", (F.col("_npx") == 1) & F.col("px").isNotNull())
    past = ~F.col("_is_end")
    rows = rows.withColumns({
        "_nv": F.count(F.when(past, F.col("volume"))).over(running),
        "_nt": F.count(F.when(past, F.lit(1))).over(running),
        "_end": F.max(F.when(F.col("px").isNotNull() & F.col("bm_px").isNotNull(), F.col("date"))).over(
            Window.partitionBy("ticker")),
    })
    priced = F.col("px").isNotNull()
    shared = priced & F.col("bm_px").isNotNull()

    def over_last(column: str, counter: str, n: int, aggregate, among: Column, skip: int = 0) -> Column:
        inside = among & (F.col(counter) > skip) & (F.col(counter) <= n + skip)
        enough = F.max(F.when(among, F.col(counter))) >= n + skip
        return F.when(enough, aggregate(F.when(inside, F.col(column))))

    def base(column: str, months: int) -> Column:
        old = shared & (F.col("date") <= F.add_months("_end", -months))
        return F.max_by(F.when(old, F.col(column)), F.when(old, F.col("date")))

    def at_end(column: str) -> Column:
        return F.max(F.when(shared & (F.col("date") == F.col("_end")), F.col(column)))

    def grown(column: str, months: int) -> Column:
        return F.when(base(column, months) > 0, safe_divide(at_end(column), base(column, months)) - 1)

    end = F.col("_is_end")
    out = rows.groupBy("ticker").agg(
        F.max(F.when(end, F.col("date"))).alias("signal_date"), F.max(F.when(end, F.col("px"))).alias("price"),
        F.count("px").alias("sessions"), F.max(F.when(end, F.col("volume"))).alias("volume"),
        *[grown("px", k).alias(f"r_{k}m") for k in (3, 6, 12)], grown("bm_px", 6).alias("bm_r_6m"),
        *[over_last("px", "_npx", n, F.avg, priced).alias(f"ma{n}") for n in (20, 50, 100, 200)],
        *[over_last("px", "_npx", n, F.max, priced, 1).alias(f"high_close{n}") for n in (20, 60)],
        over_last("volume", "_nv", 20, F.avg, past & F.col("volume").isNotNull()).alias("avg_vol20"),
        over_last("trading_value", "_nt", 20, F.avg, past).alias("avg_trading_value_20d"),
    )
    market = benchmark.select(F.max("date").alias("d")).scalar()
    bull = benchmark_panel(benchmark, benchmark, (strategy.regime_ma,)).select(
        is_true(F.max_by(F.col("bm_px") >= F.col(f"bm_ma{strategy.regime_ma}"), "date"))).scalar()
    out = out.withColumns({
        "rs_6m": F.col("r_6m") - F.col("bm_r_6m"),
        "volume_ratio": F.when(F.col("avg_vol20") > 0, safe_divide(F.col("volume"), F.col("avg_vol20"))),
        "market_bull": bull,
        "price_fresh": is_true(F.col("signal_date") == market),
    })
    return with_flags(out, strategy)


def with_flags(frame: DataFrame, strategy: Strategy) -> DataFrame:
    """Five pass flags, their weighted score, and which inputs are missing."""
    c = F.col
    trend = f"ma{strategy.trend_ma}"
    needed = ["r_3m", "r_6m", "r_12m", "rs_6m", "ma50", trend, "volume_ratio", "high_close20"]
    missing = F.concat_ws(", ", *[F.when(c(n).isNull(), n) for n in needed])
    out = frame.withColumns({
        "missing_data_reason": missing,
        "momentum_pass": is_true((c("r_3m") > 0) & (c("r_6m") > 0) & (c("r_12m") > 0)),
        "rs_pass": is_true(c("rs_6m") > 0),
        "trend_pass": is_true((c("price") > c("ma50")) & (c("ma50") > c(trend))),
        "breakout_pass": is_true(c("price") > c("high_close20")),
        "volume_pass": is_true(c("volume_ratio") >= strategy.minimum_volume_ratio),
    })
    weights = strategy.normal_weights
    met = sum((c(f).cast("long") for f in FLAGS.values()), F.lit(0))
    score = sum((c(FLAGS[name]).cast("double") * weight for name, weight in weights.items()), F.lit(0.0))
    return out.withColumns({
        "conditions_met": met,
        "buy_pass": (met >= strategy.min_buy_conditions) & (missing == ""),
        "ta_score": score,
        "ta_status": F.when(missing == "", "READY").otherwise("DATA_REVIEW"),
    })


def selection_strength(r3: str, r6: str, r12: str, rs6: str) -> Column:
    weights = ((r3, .15), (r6, .30), (r12, .35), (rs6, .20))
    return sum((F.coalesce(F.col(n), F.lit(-10.0)) * k for n, k in weights), F.lit(0.0))


def with_unified_score(frame: DataFrame, strategy: Strategy) -> DataFrame:
    """Blend of the fundamental and the price/volume score; no score counts as neutral."""
    rejected = F.coalesce(F.col("hard_reject_reason"), F.lit("")) != ""
    fa = effective_fa(F.coalesce(F.col("fa_score"), F.lit(50.0)), F.col("fa_coverage"), rejected)
    ta = F.coalesce(F.col("ta_score"), F.lit(0.0))
    return frame.withColumns({
        "effective_fa": fa,
        "unified_score": fa * strategy.fa_weight + ta * (1 - strategy.fa_weight),
        "selection_strength": selection_strength("r_3m", "r_6m", "r_12m", "rs_6m"),
    })


def with_gates(frame: DataFrame, strategy: Strategy) -> DataFrame:
    c = F.col
    return frame.withColumns({
        "ta_ready": is_true(c("ta_status") == "READY"),
        "liquid": is_true(c("avg_trading_value_20d") >= strategy.minimum_trading_value),
        "market_bull": F.coalesce(c("market_bull"), F.lit(False)),
        "price_fresh": F.coalesce(c("price_fresh"), F.lit(False)),
        "rejected": F.coalesce(c("hard_reject_reason"), F.lit("")) != "",
    }).withColumn("entry_eligible", is_true(
        (c("unified_score") >= strategy.entry_score) & ~c("rejected") & c("ta_ready")
        & c("liquid") & c("market_bull") & c("price_fresh")))


def with_exit_triggers(frame: DataFrame, strategy: Strategy) -> DataFrame:
    c = F.col
    ma = c(f"ma{strategy.exit_ma}")
    has_data = c("price").isNotNull() & ma.isNotNull()
    trailing = is_true(c("price") < c("high_close60") * (1 - strategy.trailing_stop)) \
        if strategy.trailing_stop < 1 else F.lit(False)
    out = frame.withColumns({
        "has_exit_data": has_data,
        "exit_ma_trigger": is_true(has_data & (c("price") < ma)),
        "exit_score_trigger": is_true(c("unified_score") < strategy.exit_score),
        "exit_trailing_trigger": trailing,
        "exit_market_trigger": F.lit(strategy.exit_on_market_regime) & ~F.coalesce(c("market_bull"), F.lit(False)),
    })
    return out.withColumn("exit_risk_trigger",
                          c("exit_ma_trigger") | c("exit_trailing_trigger") | c("exit_market_trigger"))


def with_rank(frame: DataFrame) -> DataFrame:
    """Candidates numbered from 1 by score, strength and ticker; others have no rank."""
    scored = stage(frame, "scored")
    order = [F.round("unified_score", 6).desc_nulls_last(), F.round("selection_strength", 6).desc_nulls_last(), F.col("ticker").asc()]
    eligible = scored.filter("entry_eligible").select("ticker", "unified_score", "selection_strength")
    return scored.join(global_row_number(eligible, order, "unified_rank").select("ticker", "unified_rank"), "ticker", "left")


def with_final_action(frame: DataFrame, strategy: Strategy) -> DataFrame:
    """The market-wide screen; holdings come in later, from the portfolio state."""
    c = F.col
    held = c("is_held") if "is_held" in frame.columns else F.lit(False)
    buy = c("entry_eligible") & is_true(c("unified_rank") <= strategy.max_positions)
    leave = c("has_exit_data") & (c("exit_risk_trigger") | c("exit_score_trigger"))
    action = first_match([
        (held & (~c("has_exit_data") | ~c("price_fresh")), "DATA_REVIEW"),
        (held & leave, "EXIT"),
        (held & c("has_exit_data"), "HOLD"),
        (~c("ta_ready"), "DATA_REVIEW"),
        (buy, "BUY"),
    ], "WATCH")
    watch = first_match([
        (~c("ta_ready"), "MISSING_TA"),
        (~c("price_fresh"), "STALE_PRICE"),
        (c("rejected"), "FA_HARD_REJECT"),
        (~c("market_bull"), "MARKET_DEFENSIVE"),
        (~c("liquid"), "ILLIQUID"),
        (is_true(c("unified_score") < strategy.entry_score), "SCORE_BELOW_ENTRY"),
        (c("entry_eligible") & ~buy, "OUTSIDE_TOP_N"),
    ], "NONE")

    def shown(value: Column, digits: int, missing: str) -> Column:
        return F.coalesce(F.round(value, digits).cast("string"), F.lit(missing))

    def flag(name: str) -> Column:
        return F.initcap(c(name).cast("string"))

    reason = F.concat(
        F.lit("FA="), shown(c("fa_score"), 1, "NA"),
        F.lit("; coverage="), shown(c("fa_coverage") * 100, 0, "0"), F.lit("%; price_volume="),
        shown(c("ta_score"), 1, "0"), F.lit("; unified="), shown(c("unified_score"), 1, "NA"),
        F.lit(f"; entry={strategy.entry_score}; exit={strategy.exit_score}; top={strategy.max_positions}; liquid="),
        flag("liquid"), F.lit("; market_bull="), flag("market_bull"), F.lit("; price_fresh="), flag("price_fresh"),
        F.lit("; reason="), c("watch_reason"),
        F.when(c("rejected"), F.concat(F.lit("; reject="), c("hard_reject_reason"))).otherwise(""),
        F.when(F.coalesce(c("missing_data_reason"), F.lit("")) != "",
               F.concat(F.lit("; missing="), c("missing_data_reason"))).otherwise(""))
    return frame.withColumns({
        "final_action": action, "watch_reason": watch,
        "market_context": F.when(c("market_bull"), "BULL_ABOVE_REGIME_MA").otherwise("DEFENSIVE_BELOW_REGIME_MA"),
    }).withColumn("decision_reason", reason)


def build_signals(fa: DataFrame, ta: DataFrame, strategy: Strategy) -> DataFrame:
    """``signals_latest``: one row per company."""
    out = with_unified_score(fa.join(ta, "ticker", "left"), strategy)
    out = with_exit_triggers(with_gates(out, strategy), strategy)
    return with_final_action(with_rank(out), strategy)


def action_rank(column: str = "final_action") -> Column:
    return first_match([(F.col(column) == a, i) for i, a in enumerate(ACTION_ORDER, 1)], len(ACTION_ORDER))
