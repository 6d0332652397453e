"""Per-ticker indicators over daily bars.

Every indicator uses the same partitioning (ticker) and order (date), so a chain
of them costs one shuffle and one sort.  A ticker has at most one bar per
session, so a partition is bounded by the length of the calendar.

A rolling value over N bars is defined only when all N are present; presence is
read from a running count and its lag, which costs O(1) per row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions.numeric import is_true, safe_divide
from tapeframe.runtime import stage

def by_date():
    return Window.partitionBy("ticker").orderBy("date")


def back(n: int, upto: int = 0):
    """The frame of the n rows that end ``upto`` rows before the current one."""
    return by_date().rowsBetween(-(n - 1) - upto, -upto)


def with_running_count(frame: DataFrame, *columns: str) -> DataFrame:
    running = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({f"_n_{c}": F.count(c).over(running) for c in columns})


def all_present(column: str, n: int, upto: int = 0) -> Column:
    """Whether the n values ending ``upto`` rows back are all non-null."""
    last = F.col(f"_n_{column}") if upto == 0 else F.lag(f"_n_{column}", upto).over(by_date())
    first = F.coalesce(F.lag(f"_n_{column}", n + upto).over(by_date()), F.lit(0))
    return last - first == n


def rolling(aggregate, column: str, n: int, upto: int = 0) -> Column:
    return F.when(all_present(column, n, upto), aggregate(column).over(back(n, upto)))


def with_blocks(frame: DataFrame, column: str) -> DataFrame:
    """Sums of the last 20, 50, 100 and 200 values and the highest of the 20 and 60 before the current one.

    Longer frames are put together from shorter ones that ended earlier, so a row costs frames of 10 values and some
    lags instead of a pass over 200.  Values are added only, never taken off again.
    """
    before = lambda name, *steps: [F.col(name), *[F.lag(name, k).over(by_date()) for k in steps]]
    total = lambda parts: functools.reduce(lambda a, b: a + b, parts)
    out = frame.withColumns({"_n_sum10": F.sum(column).over(back(10)), "_n_max10": F.max(column).over(back(10, 1))})
    out = out.withColumns({"_n_sum20": total(before("_n_sum10", 10)), "_n_sum50": total(before("_n_sum10", 10, 20, 30, 40)),
                           "_n_max20": F.greatest(*before("_n_max10", 10)), "_n_max60": F.greatest(*before("_n_max10", 10, 20, 30, 40, 50))})
    out = out.withColumn("_n_sum100", total(before("_n_sum50", 50)))
    return out.withColumn("_n_sum200", total(before("_n_sum100", 100)))


def drop_helpers(frame: DataFrame) -> DataFrame:
    return frame.drop(*[c for c in frame.columns if c.startswith("_n_")])


def moving_averages(bars: DataFrame, column: str, sizes=(20, 50, 100, 200), prefix="ma") -> DataFrame:
    out = with_running_count(bars, column)
    return drop_helpers(out.withColumns({f"{prefix}{n}": rolling(F.avg, column, n) for n in sizes}))


def prior_highs(bars: DataFrame, column: str, sizes=(20, 60)) -> DataFrame:
    """Highest close of the N sessions before the current one."""
    out = with_running_count(bars, column)
    return drop_helpers(out.withColumns({f"high_close{n}": rolling(F.max, column, n, 1) for n in sizes}))


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    out = with_running_count(bars, "volume")
    return drop_helpers(out.withColumn("volume_ratio", safe_divide(F.col("volume"), rolling(F.avg, "volume", n, 1))))


def average_trading_value(bars: DataFrame, n: int = 20) -> DataFrame:
    out = with_running_count(bars, "trading_value")
    return drop_helpers(out.withColumn(f"avg_trading_value{n}", rolling(F.avg, "trading_value", n, 1)))


def volatility(bars: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Population deviation of the last n one-bar returns."""
    out = bars.withColumn("_n_r", safe_divide(F.col(column), F.lag(column).over(by_date())) - 1)
    out = with_running_count(out, "_n_r")
    return drop_helpers(out.withColumn(f"volatility{n}", rolling(F.stddev_pop, "_n_r", n)))


def bollinger(bars: DataFrame, column: str, n: int = 20, width: float = 2.0) -> DataFrame:
    out = with_running_count(bars, column)
    out = out.withColumns({"middle": rolling(F.avg, column, n), "_n_dev": rolling(F.stddev_pop, column, n) * width})
    return drop_helpers(out.withColumns({"upper": F.col("middle") + F.col("_n_dev"),
                                         "lower": F.col("middle") - F.col("_n_dev")}))


def rsi_wilder(bars: DataFrame, column: str, n: int = 14, block: int = 512) -> DataFrame:
    """Wilder's smoothed strength index; 50 on a flat series, 100 without a loss.

    Smoothing maps the sum before to ``a * sum + move``.  In a block of sessions these maps are composed as a prefix
    sum of moves over falling powers of ``a``, which stay well within a double; the maps of whole blocks, few per
    ticker, are composed in order and carried to the rows of the next block.  Sessions without a move count as flat.
    """
    a = (n - 1) / n
    by = Window.partitionBy("ticker").orderBy("date")
    move = F.coalesce(F.col(column) - F.lag(column).over(by), F.lit(0.0))
    rows = bars.select("ticker", "date", column).withColumns({"_i": F.row_number().over(by) - 1, "_d": move})
    after = F.col("_i") > n
    rows = rows.withColumns({"_block": F.when(after, F.floor((F.col("_i") - n - 1) / block)).otherwise(-1).cast("long"),
                             "_r": F.when(after, F.pmod(F.col("_i") - n - 1, F.lit(block)) + 1).otherwise(0)})
    inside = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(a), e)
    part = lambda x: F.sum(F.greatest(x, F.lit(0.0)) * power(-F.col("_r"))).over(inside) * power(F.col("_r"))
    rows = stage(rows.select("ticker", "date", "_i", "_block", "_r", part(F.col("_d")).alias("_g"), part(-F.col("_d")).alias("_l")), "smoothed")
    ends = rows.filter((F.col("_r") == block) | (F.col("_i") == n)).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_g", "_l"))).alias("ends"))
    none = F.array().cast("array<struct<block:bigint,g:double,l:double>>")

    def carried(acc, end):
        before = F.get(acc, F.size(acc) - 1)
        on = lambda old, new: F.coalesce(old * a ** block, F.lit(0.0)) + new
        return F.concat(acc, F.array(F.struct((end["_block"] + 1).alias("block"), on(before["g"], end["_g"]).alias("g"), on(before["l"], end["_l"]).alias("l"))))

    carry = ends.select("ticker", F.explode(F.aggregate("ends", none, carried)).alias("c")).select("ticker", F.col("c.block").alias("_block"), "c.g", "c.l")
    out = rows.filter(F.col("_i") >= n).join(carry, ["ticker", "_block"], "left")
    total = lambda own, before: F.col(own) + F.coalesce(F.col(before), F.lit(0.0)) * power(F.col("_r"))
    gain, loss = total("_g", "g"), total("_l", "l")
    level = F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))
    return out.select("ticker", "date", level.alias("rsi"))


def prev_valid_returns(bars: DataFrame) -> DataFrame:
    """Return against the previous bar that is valid and was traded.

    Bars that are not valid keep their row with empty returns and never appear on
    either side of a return.
    """
    usable = is_true(F.col("analysis_ready") & (F.col("adjusted_close") > 0) & (F.col("volume") > 0))
    out = bars.withColumn("_n_u", usable)
    # The flag joins the window key, so both kinds of bar stay in the ticker's partition.
    among = Window.partitionBy("ticker", "_n_u").orderBy("date")
    previous = F.lag(F.struct("date", "adjusted_close")).over(among)
    out = out.withColumn("_n_p", F.when(F.col("_n_u"), previous))
    ratio = F.try_divide(F.col("adjusted_close"), F.col("_n_p.adjusted_close"))
    return drop_helpers(out.withColumns({
        "previous_price_date": F.col("_n_p.date"),
        "return_gap_calendar_days": F.date_diff("date", F.col("_n_p.date")).cast("long"),
        "return_prev_session": ratio - 1,
        "log_return_prev_session": F.ln(ratio),
    }))


def session_ordinals(calendar: DataFrame) -> DataFrame:
    """Number the market sessions from 1; the calendar is one small partition by nature."""
    return calendar.select("date").distinct().withColumn(
        "session", F.row_number().over(Window.orderBy("date")).cast("long"))


def strict_session_returns(bars: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Keep a return only where the two bars are consecutive market sessions."""
    before = ordinals.select(F.col("date").alias("previous_price_date"), F.col("session").alias("_n_before"))
    out = bars.join(ordinals.withColumnRenamed("session", "_n_now"), "date", "left").join(
        before, "previous_price_date", "left")
    gap = F.col("_n_now") - F.col("_n_before")
    return drop_helpers(out.withColumns({
        "return_gap_trading_sessions": gap,
        "return_1d": F.when(gap == 1, F.col("return_prev_session")),
        "log_return_1d": F.when(gap == 1, F.col("log_return_prev_session")),
    }))


def session_number_asof(frame: DataFrame, column: str, ordinals: DataFrame, name: str) -> DataFrame:
    """Number of sessions up to each date, session or not.

    The calendar is spread to every day it spans, which keeps this an equality join.
    """
    following = F.lead("date").over(Window.orderBy("date"))
    spans = ordinals.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col("date")))
    days = spans.select("session", F.explode(F.sequence("date", "_until")).alias(column)).withColumnRenamed("session", "_s")
    last, total = ordinals.select(F.max("date")).scalar(), ordinals.select(F.max("session")).scalar()
    out = frame.join(days, column, "left")
    return out.withColumn(name, F.when(F.col(column) > last, total).when(
        F.col(column).isNotNull(), F.coalesce("_s", F.lit(0)))).drop("_s")
