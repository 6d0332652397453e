"""Evaluation over history: Top-N returns, performance, sweeps and gates."""

from __future__ import annotations

import functools
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions.numeric import first_match, is_true
from tapeframe.operators.signals import selection_strength
from tapeframe.operators.windows import by_date
from tapeframe.params import Strategy
from tapeframe.runtime import stage


def components(volume_ratio) -> dict:
    """The five pass conditions on history columns."""
    c = F.col
    return {
        "momentum": is_true((c("r3") > 0) & (c("r6") > 0) & (c("r12") > 0)),
        "relative_strength": is_true(c("rs6") > 0),
        "trend": is_true((c("px") > c("ma50")) & (c("ma50") > c("ma200"))),
        "breakout": is_true(c("px") > c("high_close20")),
        "volume": is_true(c("volume_ratio") >= volume_ratio),
    }


def with_history_score(frame: DataFrame, strategy: Strategy) -> DataFrame:
    """Unified score at every bar; without a usable fundamental score there is none."""
    passed = components(strategy.minimum_volume_ratio)
    market = sum((passed[n].cast("double") * weight for n, weight in strategy.normal_weights.items()), F.lit(0.0))
    return frame.withColumn(
        "score", F.col("effective_fa") * strategy.fa_weight + market * (1 - strategy.fa_weight))


# Component weight profiles of the parameter search.
PROFILES = {
    "balanced": {"momentum": 20, "relative_strength": 20, "trend": 20, "breakout": 20, "volume": 20},
    "momentum_quality": {"momentum": 30, "relative_strength": 25, "trend": 25, "breakout": 15, "volume": 5},
    "trend_breakout": {"momentum": 20, "relative_strength": 20, "trend": 30, "breakout": 25, "volume": 5},
    "momentum_breakout": {"momentum": 30, "relative_strength": 20, "trend": 20, "breakout": 25, "volume": 5},
}
CONFIG_FIELDS = ("config", "parent", "name", *PROFILES["balanced"], "fa_weight", "entry_score", "volume_ratio",
                 "regime_ma", "max_positions", "liquidity", "cost", "vol_target")


def config(id_: int, name: str, strategy: Strategy, cost: float = 0.0015, vol_target: float = 0.0,
           parent: int | None = None) -> dict:
    """One flat row of parameters; a list of them is what a sweep evaluates."""
    return {"config": id_, "parent": id_ if parent is None else parent, "name": name,
            **{k: float(v) for k, v in strategy.normal_weights.items()},
            "fa_weight": float(strategy.fa_weight), "entry_score": float(strategy.entry_score),
            "volume_ratio": float(strategy.minimum_volume_ratio), "regime_ma": int(strategy.regime_ma),
            "max_positions": int(strategy.max_positions), "liquidity": float(strategy.minimum_trading_value),
            "cost": float(cost), "vol_target": float(vol_target)}


def grid(base: Strategy, axes: dict, count: int) -> list[dict]:
    """The base configuration, then ``count - 1`` distinct combinations of the axes, drawn by digest.

    Draw n picks the combination whose number is the digest of n, so neither the product of the axes is listed nor
    does a longer sample change a shorter one.
    """
    sizes = [len(values) for values in axes.values()]
    total = math.prod(sizes)
    picked, seen, draw = [config(0, "baseline", base)], set(), 0
    while len(picked) < count and len(seen) < total:
        number = int(hashlib.sha256(f"draw {draw}".encode()).hexdigest(), 16) % total
        draw += 1
        if number in seen:
            continue
        seen.add(number)
        changes = {}
        for (name, values), size in zip(axes.items(), sizes):
            changes[name], number = values[number % size], number // size
        text = ";".join(f"{k}={v}" for k, v in sorted(changes.items()))
        if "profile" in changes:
            changes["component_weights"] = PROFILES[changes.pop("profile")]
        candidate = base.with_(**changes)
        if candidate != base:
            picked.append(config(len(picked), text, candidate))
    return picked


def ablations(base: Strategy) -> list[dict]:
    """Baseline and one component removed at a time.

    Variants of exits (trailing stop, exit average) do not change a set-based return and are left out.
    """
    out = [("baseline", base)]
    for name in base.component_weights:
        out.append((f"without_{name}", base.with_(component_weights={**base.component_weights, name: 0.0})))
    return [config(i, n, s) for i, (n, s) in enumerate(out)]


def experiments(base: Strategy) -> list[dict]:
    """Baseline and volatility cap; the turnover guard works through exits, which a set-based return has not got."""
    return [config(0, "baseline", base), config(1, "volatility_cap", base, vol_target=0.025)]


# The local changes around a chosen configuration that change a set-based return.
NEIGHBOUR_STEPS = [("entry_score", -5), ("entry_score", 5), ("max_positions", -5), ("max_positions", 5), ("fa_weight", -.05), ("fa_weight", .05)]
LIMITS = {"max_positions": (1, 10 ** 6), "fa_weight": (.05, .9)}


def neighbours(parent: dict, first_id: int) -> list[dict]:
    """Local changes of one configuration."""
    out = []
    for i, (name, step) in enumerate(NEIGHBOUR_STEPS):
        low, high = LIMITS.get(name, (float("-inf"), float("inf")))
        out.append({**parent, "config": first_id + i, "parent": parent["config"], "name": f"{name}{step:+}",
                    name: type(parent[name])(min(high, max(low, parent[name] + step)))})
    return out


MEMBER = ("config", "entry_score", "regime_ma", "max_positions", "liquidity", "cost", "vol_target")
SCORING = (*PROFILES["balanced"], "fa_weight", "volume_ratio")


def _kinds(names) -> str:
    kind = {"name": "string", **{n: "bigint" for n in ("config", "parent", "regime_ma", "max_positions")}}
    return ",".join(f"{n}:{kind.get(n, 'double')}" for n in names)


def config_array(configs: list[dict]) -> Column:
    """The configurations as one constant; their number is that of the sweep."""
    rows = [{k: c[k] for k in CONFIG_FIELDS} for c in configs]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_kinds(CONFIG_FIELDS)}>>")


def scoring_array(configs: list[dict]) -> Column:
    """Configurations by what they score alike, each group with its least entry score."""
    groups: dict[tuple, dict] = {}
    for c in configs:
        group = groups.setdefault(tuple(c[k] for k in SCORING), {**{k: c[k] for k in SCORING}, "least": c["entry_score"], "members": []})
        group["least"] = min(group["least"], c["entry_score"])
        group["members"].append({k: c[k] for k in MEMBER})
    kind = f"array<struct<{_kinds(SCORING)},least:double,members:array<struct<{_kinds(MEMBER)}>>>>"
    return F.from_json(F.lit(json.dumps(list(groups.values()))), kind)


REGIMES = (50, 100, 200)


FIXED = tuple(n for n in PROFILES["balanced"] if n != "volume")  # conditions without a threshold in the configurations


def regime_holds(ma: int) -> Column:
    return is_true(F.col("bm_px") >= F.col(f"bm_ma{ma}"))


def regime_of(config: dict) -> int:
    return config["regime_ma"] if config["regime_ma"] in REGIMES else 200


def thresholds(configs: list[dict], name: str) -> list[float]:
    return sorted({k[name] for k in configs})


def reached(column: str, steps: list[float]) -> Column:
    """The highest of the steps that the value reaches, null below the least: compares with each step as the value does."""
    return first_match([(F.col(column) >= x, F.lit(x)) for x in reversed(steps)])


def contenders(rows: DataFrame, configs: list[dict], most: int) -> DataFrame:
    """The bars that can be among the ``most`` best of a session under some configuration, and few others.

    Bars of a session that pass the same conditions at every threshold of the sweep pass the same gates and have the
    same market score, so under each configuration they are ordered by their fundamental score, then by strength and
    ticker where rounded scores are equal.  A bar goes where ``most`` bars like it are ahead by more than rounding can
    hide.  Rows move once, by session and before they meet the configurations, as what ``sweep_panel`` made of them;
    what is left of a session does not grow with the number of tickers.
    """
    least = min(k["fa_weight"] for k in configs)
    rows = rows.repartition("date")
    if least <= 0:
        return rows
    flags = [is_true(F.col("volume_ratio") >= x) for x in thresholds(configs, "volume_ratio")]
    flags += [F.col(name) for name in FIXED]
    flags += [is_true(F.col("avg_trading_value20") >= x) for x in thresholds(configs, "liquidity")]
    flags += [F.col(f"regime{ma}") for ma in REGIMES]
    alike = sum((F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)) for i, flag in enumerate(flags)), F.lit(0))
    step = F.floor(F.col("effective_fa") / (4e-6 / least))  # two steps apart: scores differ by more than 4e-6
    step = F.when(F.isnan("effective_fa"), F.lit(1 << 62)).otherwise(step)
    clear = Window.partitionBy("date", "_alike").orderBy(F.col("_step").desc()).rangeBetween(Window.unboundedPreceding, -2)
    rows = rows.withColumns({"_alike": alike, "_step": step}).withColumn("_ahead", F.count("*").over(clear))
    return rows.filter(F.col("_ahead") < most).drop("_alike", "_step", "_ahead")


BESIDE = ("px1", "px2", "prev_vol", "prev_adv")  # what a sweep reads of a ticker's other bars
GATED = ("px", "bm_px", *[f"bm_ma{ma}" for ma in REGIMES], "r3", "r6", "r12", "rs6", "ma50", "ma200", "high_close20", "volume_ratio",
         "avg_trading_value20", "effective_fa", "fa_eligible", "fill")


def with_neighbours(history: DataFrame, fill: str = "px") -> DataFrame:
    """The bars that have the returns and averages every configuration asks for, each with what a sweep reads of its
    ticker's other bars; no others and no other columns.

    Sweeps over one history need it once: they don't move bars to their ticker again, and far fewer are kept for them.
    """
    own = F.lead(fill, 1).over(by_date()), F.lead(fill, 2).over(by_date())
    rows = history.withColumns({"px1": own[0], "px2": own[1], "prev_vol": F.lag("volatility20").over(by_date()),
                                "prev_adv": F.lag("avg_trading_value20").over(by_date())})
    rows = rows.filter(F.col("r12").isNotNull() & F.col("ma200").isNotNull())
    return rows.select("ticker", "date", *[n for n in dict.fromkeys([*GATED, fill]) if n in rows.columns], *BESIDE)


def sweep_panel(history: DataFrame, configs: list[dict], fill: str = "px", most: int | None = None) -> DataFrame:
    """Every bar under every configuration that would enter it; with ``most`` only those among which the ``most`` best
    of each configuration and session are.

    Gates that no configuration can change come first, and what the configurations ask of a bar is kept as conditions
    and thresholds reached, not as the prices and averages behind them.  A bar is scored once for each way of scoring,
    and only where that reaches the least entry score the configurations of that group are looked at, so only entering
    pairs go any further.  ``fill`` names the price that fills orders; ``history`` may come from ``with_neighbours``.
    """
    c = F.col
    core = (c("r12").isNotNull() & c("ma200").isNotNull() & c("effective_fa").isNotNull() & c("fa_eligible")
            & (c("avg_trading_value20") >= min(k["liquidity"] for k in configs))
            & functools.reduce(lambda a, b: a | b, [regime_holds(ma) for ma in sorted({regime_of(k) for k in configs})]))
    rows = (history if set(BESIDE) <= set(history.columns) else with_neighbours(history, fill)).filter(core)
    fixed = components(0.0)
    rows = rows.withColumn("strength", selection_strength("r3", "r6", "r12", "rs6")).select(
        "ticker", "date", "effective_fa", "strength", "px", "px1", "px2", "prev_vol", "prev_adv",
        reached("avg_trading_value20", thresholds(configs, "liquidity")).alias("avg_trading_value20"),
        reached("volume_ratio", thresholds(configs, "volume_ratio")).alias("volume_ratio"),
        *[fixed[n].alias(n) for n in FIXED], *[regime_holds(ma).alias(f"regime{ma}") for ma in REGIMES])
    if most is not None:
        rows = contenders(rows, configs, most)
    rows = rows.select("*", F.explode(scoring_array(configs)).alias("g"))
    g = lambda n: c(f"g.{n}")
    passed = {**{n: c(n) for n in FIXED}, "volume": is_true(c("volume_ratio") >= g("volume_ratio"))}
    market = sum((passed[n].cast("double") * g(n) for n in PROFILES["balanced"]), F.lit(0.0))
    rows = rows.withColumn("score", c("effective_fa") * g("fa_weight") + market * (1 - g("fa_weight"))).filter(c("score") >= g("least"))

    def enters(m):
        regime = F.when(m["regime_ma"] == 50, c("regime50")).when(m["regime_ma"] == 100, c("regime100")).otherwise(c("regime200"))
        return (c("score") >= m["entry_score"]) & (c("avg_trading_value20") >= m["liquidity"]) & regime

    rows = rows.withColumn("m", F.explode(F.filter(g("members"), enters)))
    return rows.select("m.config", "ticker", "date", "score", "strength", "px", "px1", "px2", "prev_vol", "prev_adv",
                       "m.max_positions", "m.cost", "m.vol_target")


def members(panel: DataFrame, most_positions: int) -> DataFrame:
    """The Top-N of each configuration and session."""
    order = [F.round("score", 6).desc(), F.round("strength", 6).desc(), F.col("ticker").asc()]
    w = Window.partitionBy("config", "date").orderBy(*order)
    return panel.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most_positions).filter(
        F.col("rank") <= F.col("max_positions"))


def with_weights(rows: DataFrame) -> DataFrame:
    """Equal weights, cut where the previous session's volatility is above target; none without that volatility."""
    cap = F.least(F.lit(1.0), F.try_divide("vol_target", "prev_vol"))
    scale = F.when(F.col("vol_target") <= 0, 1.0).when(F.col("prev_vol") > 0, cap).otherwise(0.0)
    return rows.withColumn("weight", scale / F.col("max_positions"))


def daily_returns(picked: DataFrame, calendar: DataFrame, configs: Column) -> DataFrame:
    """Return, turnover and holdings of each configuration on every session.

    Decided at t, filled at the ticker's next bar, earning to the one after.  What
    enters or leaves is read from each ticker's own membership line.
    """
    rows = with_weights(picked).join(calendar, "date")
    line = Window.partitionBy("config", "ticker").orderBy("session")
    came = F.coalesce(F.lag("session").over(line) != F.col("session") - 1, F.lit(True))
    goes = F.coalesce(F.lead("session").over(line) != F.col("session") + 1, F.lit(True))
    gain = F.coalesce(F.try_divide("px2", "px1") - 1, F.lit(0.0)) * F.col("weight")
    rows = rows.withColumns({"came": came.cast("long"), "goes": goes.cast("long"), "gain": gain})
    today = rows.groupBy("config", "session").agg(F.sum("gain").alias("gain"), F.count("*").alias("holdings"),
                                                  F.sum("came").alias("came"), F.sum("weight").alias("exposure"))
    left = rows.filter("goes = 1").groupBy("config", (F.col("session") + 1).alias("session")).agg(F.count("*").alias("went"))
    every = calendar.select("date", "session", F.explode(configs).alias("c"))
    every = every.select(
        "date", "session", F.col("c.config").alias("config"), F.col("c.max_positions").alias("n"), F.col("c.cost").alias("cost"))
    out = every.join(today, ["config", "session"], "left").join(left, ["config", "session"], "left").fillna(
        0, ["came", "went", "holdings"]).fillna(0.0, ["gain", "exposure"])
    turnover = (F.col("came") + F.col("went")) / F.col("n")
    return out.select("config", "date", "session", (F.col("gain") - F.col("cost") * turnover).alias("ret"),
                      turnover.alias("turnover"), "holdings", (1 - F.col("exposure")).alias("cash_weight"))


def sweep(history: DataFrame, calendar: DataFrame, configs: list[dict], fill: str = "px") -> DataFrame:
    """Daily results of every configuration."""
    most = max(c["max_positions"] for c in configs)
    picked = stage(members(sweep_panel(history, configs, fill, most), most), "picked")  # read twice
    return daily_returns(picked, calendar, config_array(configs))


def at_cost(daily: DataFrame, more: float) -> DataFrame:
    """The same days at a cost higher by ``more``."""
    return daily.withColumn("ret", F.col("ret") - more * F.col("turnover"))


def running_equity(rows: DataFrame, by: list[str], ret: str) -> DataFrame:
    """Compounded value from 1, and the fall from its highest point so far or the start."""
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("equity", F.product(1 + F.col(ret)).over(upto))
    return out.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(upto)) - 1)


def metrics(rows: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """Growth, Sharpe, drawdown, turnover and mean holdings per group of (date, ret, turnover, holdings).

    ``strict`` leaves undefined values missing; the sweep variant scores them as the worst.
    """
    years = F.count("*") / 252.0
    end = F.max_by("equity", "date")
    spread = F.stddev_pop("ret")
    growth = F.when(end > 0, F.pow(end, 1.0 / years) - 1)
    sharpe = F.when(spread > 1e-12, F.lit(252.0 ** 0.5) * F.avg("ret") / spread)
    if not strict:
        growth, sharpe = F.coalesce(growth, F.lit(-1.0)), F.coalesce(sharpe, F.lit(0.0))
    return running_equity(rows, by, "ret").groupBy(*by).agg(
        F.count("*").alias("sessions"), growth.alias("cagr"), sharpe.alias("sharpe"),
        F.min("drawdown").alias("maximum_drawdown"), (F.sum("turnover") / years).alias("annual_turnover"),
        F.avg("holdings").alias("average_positions"))


def positive_months(rows: DataFrame, by: list[str]) -> DataFrame:
    months = rows.groupBy(*by, F.trunc("date", "MM").alias("_m")).agg((F.product(1 + F.col("ret")) - 1).alias("_r"))
    return months.groupBy(*by).agg(F.avg((F.col("_r") > 0).cast("double")).alias("positive_month_rate"))


def in_periods(rows: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Repeat each row for every named period that contains it."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
                      for n, a, b in periods])
    hits = F.filter(table, lambda p: (F.col("date") >= p["a"]) & (F.col("date") <= p["b"]))
    return rows.select("*", F.explode(hits).alias("_p")).withColumn("period", F.col("_p.name")).drop("_p")


def benchmark_returns(benchmark: DataFrame) -> DataFrame:
    """The calendar's own series: one small partition."""
    change = F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1
    return benchmark.select("date", F.coalesce(change, F.lit(0.0)).alias("ret"), F.lit(0.0).alias("turnover"),
                            F.lit(0).alias("holdings"))


# A configuration must hold this many names on average and not turn over more than this a year.
MIN_POSITIONS, MAX_TURNOVER = 5, 18


def objective(daily: DataFrame, benchmark: DataFrame, cutoffs: list[int], by=("config",),
              min_positions: float = MIN_POSITIONS, max_turnover: float = MAX_TURNOVER) -> DataFrame:
    """Training objective of each configuration at each cutoff year, from earlier returns only.

    Folds are calendar years with at least 100 sessions; under 252 sessions there is none.
    """
    by = list(by)
    later = F.filter(F.array(*[F.lit(y) for y in cutoffs]), lambda y: y > F.year("date"))
    known = daily.select("*", F.explode(later).alias("cutoff"))
    train = metrics(known, [*by, "cutoff"], strict=False).filter("sessions >= 252")
    base = metrics(benchmark.select("*", F.explode(later).alias("cutoff")), ["cutoff"], strict=False).select(
        "cutoff", F.col("cagr").alias("bm_cagr"))
    fold = metrics(daily.withColumn("year", F.year("date")), [*by, "year"], strict=False).filter("sessions >= 100")
    bm_fold = metrics(benchmark.withColumn("year", F.year("date")), ["year"], strict=False).select(
        "year", F.col("cagr").alias("bm_fold_cagr"))
    fold = fold.join(bm_fold, "year").select(
        *by, "year", "sharpe", (F.col("cagr") - F.col("bm_fold_cagr")).alias("alpha"), "maximum_drawdown")
    cuts = F.filter(F.array(*[F.lit(y) for y in cutoffs]), lambda y: y > F.col("year"))
    folds = fold.select("*", F.explode(cuts).alias("cutoff")).groupBy(*by, "cutoff").agg(
        F.avg("sharpe").alias("s_mean"), F.min("sharpe").alias("s_min"), F.avg("alpha").alias("a_mean"),
        F.min("alpha").alias("a_min"), F.min("maximum_drawdown").alias("dd"))
    out = train.join(folds, [*by, "cutoff"]).join(base, "cutoff")
    good = (0.45 * F.col("s_mean") + 0.25 * F.col("s_min") + 2.0 * F.col("a_mean") + F.col("a_min")
            + 0.5 * (F.col("cagr") - F.col("bm_cagr")) - 0.5 * F.abs("dd") - 0.02 * F.col("annual_turnover"))
    bad = (F.col("annual_turnover") > max_turnover) | (F.col("average_positions") < min_positions)
    return out.withColumn("objective", F.when(bad, -100 - F.col("annual_turnover")).otherwise(good))


def ranked(scored: DataFrame) -> DataFrame:
    """Rank configurations per cutoff; their number is that of the sweep."""
    w = Window.partitionBy("cutoff").orderBy(F.round("objective", 6).desc(), F.col("config").asc())
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def position_changes(held: DataFrame) -> DataFrame:
    """Entries of a 0/1 holding line per ticker, each with its next exit if any.

    ``held`` has ticker, date, px and held for every bar of the ticker.
    """
    bars = by_date()
    out = held.withColumns({"bar": F.row_number().over(bars).cast("long"), "_was": F.coalesce(F.lag("held").over(bars), F.lit(0)),
                            "prev_px": F.lag("px").over(bars)})
    exits = F.when((F.col("held") == 0) & (F.col("_was") == 1), F.struct("bar", "date", "px", "prev_px"))
    # Newest first, so the rows ahead are a growing frame.
    ahead = Window.partitionBy("ticker").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"exit": F.min(exits).over(ahead), "bars": F.count("*").over(Window.partitionBy("ticker"))})
    return out.filter("held = 1 AND _was = 0").select(
        "ticker", F.col("date").alias("entry_date"), F.col("bar").alias("entry_bar"), F.col("px").alias("entry_price"),
        F.col("prev_px").alias("entry_prev_price"), F.col("exit.date").alias("exit_date"), F.col("exit.bar").alias("exit_bar"),
        F.col("exit.px").alias("exit_price"), F.col("exit.prev_px").alias("exit_prev_price"), "bars")


def trade_ledger(changes: DataFrame, cost: float) -> DataFrame:
    """Trades at closing fills, costs on both sides, open holdings kept open."""
    gross = F.try_divide("exit_price", "entry_price") - 1
    closed = F.col("exit_bar").isNotNull()
    return changes.select(
        "ticker", "entry_date", "exit_date", F.when(closed, "CLOSED").otherwise("OPEN").alias("status"),
        "entry_price", "exit_price", gross.alias("gross_return"), ((1 + gross) * (1 - cost) / (1 + cost) - 1).alias("net_return"),
        F.when(closed, F.col("exit_bar") - F.col("entry_bar")).otherwise(F.col("bars") - F.col("entry_bar")).alias("holding_sessions"))


def ledger_statistics(trades: DataFrame) -> DataFrame:
    """Closed trades after cost; a zero return is neither win nor loss."""
    net, done = F.col("net_return"), F.col("status") == "CLOSED"
    win, loss = F.when(done & (net > 0), net), F.when(done & (net < 0), net)
    return trades.agg(
        F.count(F.when(done, 1)).alias("trade_count"), F.count(F.when(~done, 1)).alias("open_trade_count"),
        F.avg(F.when(done, (net > 0).cast("double"))).alias("winning_trade_rate"),
        F.avg(F.when(done, F.col("gross_return"))).alias("average_trade_return_before_cost"),
        F.avg(F.when(done, net)).alias("average_trade_return_after_cost"), F.avg(win).alias("average_win_return"),
        F.avg(loss).alias("average_loss_return"), F.max(win).alias("max_win_return"), F.min(loss).alias("max_loss_return"))


def trade_statistics(changes: DataFrame) -> DataFrame:
    """Before cost, at the closes before entry and exit; a zero return counts as a loss."""
    value = F.when((F.col("entry_prev_price") > 0) & F.col("exit_bar").isNotNull(),
                   F.col("exit_prev_price") / F.col("entry_prev_price") - 1)
    rows = changes.withColumn("v", value)
    win, loss = F.when(F.col("v") > 0, F.col("v")), F.when(F.col("v") <= 0, F.col("v"))
    return rows.agg(
        F.count("v").alias("trade_count"), F.count(F.when(F.col("exit_bar").isNull(), 1)).alias("open_trade_count"),
        F.avg((F.col("v") > 0).cast("double")).alias("winning_trade_rate"), F.avg("v").alias("average_trade_return_before_cost"),
        F.avg(win).alias("average_win_return"), F.avg(loss).alias("average_loss_return"),
        F.max("v").alias("max_win_return"), F.min("v").alias("max_loss_return"))


def check_rows(row: DataFrame, checks: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One (check, passed) row per check and an all_passed row."""
    keys = keys or []
    named = [F.struct(F.lit(n).alias("check"), is_true(v).alias("passed")) for n, v in checks.items()]
    every = is_true(functools.reduce(lambda a, b: a & b, checks.values()))
    named.append(F.struct(F.lit("all_passed").alias("check"), every.alias("passed")))
    return row.select(*keys, F.explode(F.array(*named)).alias("_c")).select(*keys, "_c.check", "_c.passed")
