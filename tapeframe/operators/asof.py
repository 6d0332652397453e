"""As-of alignment without pairing rows.

Values are carried forward along a time line, or read with a range frame, so the
work is the sum of the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions.numeric import safe_divide
from tapeframe.runtime import stage


def benchmark_panel(benchmark: DataFrame, dates: DataFrame, sizes=(50, 100, 200)) -> DataFrame:
    """Index price and its averages on every date, carried forward where it has no bar.

    One small partition: its length is the calendar's.
    """
    order = Window.orderBy("date")
    series = benchmark.select("date", F.col("close").alias("bm_px"))
    for n in sizes:
        frame = order.rowsBetween(-(n - 1), 0)
        series = series.withColumn(f"bm_ma{n}", F.when(F.count("bm_px").over(frame) == n,
                                                       F.avg("bm_px").over(frame)))
    names = [c for c in series.columns if c != "date"]
    packed = dates.select("date").distinct().join(
        series.select("date", F.struct(*names).alias("_v"), F.lit(True).alias("is_session")), "date", "full")
    carried = packed.withColumn("_v", F.last("_v", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    return carried.select("date", F.coalesce("is_session", F.lit(False)).alias("is_session"), "_v.*")


def with_index(bars: DataFrame, panel: DataFrame) -> DataFrame:
    """Bars beside the index columns of their date, partitioned by ticker.

    Bars move once, by ticker and before they get those columns; the panel is staged, so that Spark knows how short it
    is and sends it to the bars.
    """
    return bars.repartition("ticker").join(stage(panel, "index_panel"), "date", "left")


def calendar_returns(panel: DataFrame, months=(3, 6, 12)) -> DataFrame:
    """Return of each ticker since the last shared session at least k months back.

    ``panel`` has ticker, date, px, bm_px and is_session.  Only dates both series
    have can be a base or an end; other dates take the last shared date's result.
    A missing or non-positive base gives no return.  ``with_index`` leaves rows
    partitioned by ticker; the windows below, and those of the caller, all fit that.
    """
    out = panel.withColumn("_shared", F.coalesce(F.col("is_session"), F.lit(False)))

    def base(column: str, k: int):
        return F.expr(
            f"last_value({column}) OVER (PARTITION BY ticker, _shared ORDER BY date "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {k} MONTH PRECEDING)")

    def grown(column: str, k: int):
        b = base(column, k)
        return F.when(b > 0, safe_divide(F.col(column), b) - 1)

    wanted = {f"r{k}": grown("px", k) for k in months} | {"bm_r6": grown("bm_px", 6)}
    out = out.withColumns(wanted)
    names = list(wanted)
    carry = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_r", F.last(F.when(F.col("_shared"), F.struct(*names)), ignorenulls=True).over(carry))
    out = out.drop(*names).select("*", "_r.*").drop("_r", "_shared")
    return out.withColumn("rs6", F.col("r6") - F.col("bm_r6")) if 6 in months else out
