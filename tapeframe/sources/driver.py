"""Domain tables as views over the driver's Parquet tables.

``Market(spark, folder)`` offers the tables every operator consumes.  A frame is
a lazy plan; a caller that needs the bars more than once asks for
``staged_bars`` and pays for one scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.numeric import exact_sum
from tapeframe.runtime import stage


def ticker_of(key) -> F.Column:
    return F.concat(F.lit("S"), key.cast("string"))


class Market:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """One bar per ticker and session.

        Open and close are the prices with the smallest and largest trade number.
        The order key is one fixed-width decimal (order, line, then price as tie
        break), so the aggregation stays hash-based.  Most sessions of a ticker hold
        a trade or two, so combining before the shuffle would fill the map tasks with
        groups and move buffers wider than trades: trades move as they are, by ticker
        and session, and a ticker holding a third of them is spread over its sessions.
        """
        moved = self.table("lineitem").filter("l_quantity > 0").select(
            "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber",
            "l_quantity", "l_extendedprice").repartition("l_suppkey", "date")
        trades = moved.select(
            "l_suppkey", "date",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            "l_quantity", "l_extendedprice",
            ((F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(38,14)")
             + (F.col("l_extendedprice") / F.col("l_quantity") / 1e6).cast("decimal(38,14)"))
            .cast("decimal(38,14)").alias("seq"),
        )
        return (
            trades.groupBy("l_suppkey", "date")
            .agg(
                F.min_by("px", "seq").alias("open"), F.max("px").alias("high"),
                F.min("px").alias("low"), F.max_by("px", "seq").alias("close"),
                F.sum("l_quantity").alias("volume"),
                exact_sum(F.col("l_extendedprice"), 2).alias("trading_value"),
            )
            .select(ticker_of(F.col("l_suppkey")).alias("ticker"), "date", "open", "high", "low",
                    "close", "volume", "trading_value")
        )

    @cached_property
    def staged_bars(self) -> DataFrame:
        return stage(self.bars, "bars")

    def over_staged_bars(self) -> Market:
        """The same market with everything that comes from bars read from one staged copy of them."""
        out = Market(self.spark, self.folder)
        out.bars = out.staged_bars = self.staged_bars
        return out

    def benchmark_of(self, bars: DataFrame) -> DataFrame:
        """Market index and trading calendar; one row per session."""
        return bars.groupBy("date").agg(
            (exact_sum(F.col("trading_value"), 2) / F.sum("volume")).alias("close"),
            F.sum("volume").alias("volume"),
        )

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.benchmark_of(self.bars)

    @cached_property
    def staged_benchmark(self) -> DataFrame:
        return stage(self.benchmark_of(self.staged_bars), "benchmark")

    @cached_property
    def companies(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("company_name"),
            F.when(F.col("s_nationkey") % 2 == 0, "HOSE").otherwise("HNX").alias("exchange"),
            F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 10000).alias("market_cap"),
            F.when(F.col("s_acctbal") < 0, "restricted").otherwise("normal").alias("trading_status"),
        )

    @cached_property
    def fin_wide(self) -> DataFrame:
        """One row per ticker and fiscal year, one column per statement item."""
        price, status, flag = F.col("l_extendedprice"), F.col("l_linestatus"), F.col("l_returnflag")

        def total(value, name):
            return exact_sum(value, 4).alias(name)

        lines = self.table("lineitem").join(
            self.table("part").select("p_partkey", "p_retailprice"),
            F.col("l_partkey") == F.col("p_partkey"))
        sums = lines.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").cast("long").alias("fiscal_year")).agg(
            total(price * (1 - F.col("l_discount")), "r"),
            total(F.col("l_quantity") * F.col("p_retailprice"), "c"),
            total(price * F.col("l_tax"), "i"), total(price, "e"),
            total(F.when(status == "F", price).otherwise(-price), "cfo"),
            total(F.when(status == "O", price).otherwise(price * -0.8), "eq"),
            total(F.when(flag == "N", price), "ca"), total(F.when(flag == "A", price), "cl"),
            total(F.when(F.col("l_discount") >= 0.095, price), "sb"),
            total(F.when(F.col("l_discount") <= 0.005, price), "lb"),
            total(F.when(F.col("l_linenumber") == 1, price), "cash"),
        ).filter((F.col("k") + F.col("fiscal_year")) % 11 != 0)
        r, c, i, e, eq = (F.col(x) for x in ("r", "c", "i", "e", "eq"))
        ebit = r * 0.55 - c
        pbt = ebit - i
        return sums.select(
            ticker_of(F.col("k")).alias("ticker"), "fiscal_year",
            F.make_date(F.col("fiscal_year").cast("int"), F.lit(12), F.lit(31)).alias("period_end"),
            r.alias("revenue"), (r - c).alias("gross_profit"), ebit.alias("ebit"),
            i.alias("interest_expense"), pbt.alias("profit_before_tax"), (pbt * 0.8).alias("net_income"),
            (pbt * 0.8 / 1000).alias("eps"), (e * 2).alias("total_assets"), (eq + e * 0.15).alias("equity"),
            (e * 1.85 - eq).alias("total_liabilities"), F.col("cash").alias("cash_and_cash_equivalents"),
            F.col("ca").alias("current_assets"), F.col("cl").alias("current_liabilities"),
            F.col("sb").alias("short_term_borrowings"), F.col("lb").alias("long_term_borrowings"),
            F.col("cfo").alias("operating_cash_flow"), (e * 0.05).alias("depreciation"),
            F.when(F.col("fiscal_year") % 2 == 0, e * 0.01).alias("amortization"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Corporate actions: one per ticker and calendar year, on its first session."""
        kind = F.year("date") % 5

        def only(code, value):
            return F.when(F.col("code") == code, F.lit(value))

        return self.bars.groupBy("ticker", F.year("date").alias("y")).agg(F.min("date").alias("ex_date")) \
            .withColumn("code", F.col("y") % 5).select(
                "ticker", "ex_date",
                F.when(F.col("code") == 0, "cash_dividend").when(F.col("code") == 1, "stock_dividend")
                .when(F.col("code") == 2, "stock_split").when(F.col("code") == 3, "rights_issue")
                .otherwise("capital_increase").alias("action_type"),
                only(0, 15.0).alias("cash_dividend"), only(1, 10.0).alias("stock_ratio"),
                only(2, 2.0).alias("split_ratio"), only(3, 0.2).alias("rights_ratio"),
                only(3, 100.0).alias("rights_price"))

    @cached_property
    def trades(self) -> DataFrame:
        """Order log per account."""
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("account"),
            F.when(F.col("event_type").isin("purchase", "click", "view"), "BUY").otherwise("SELL").alias("side"),
            ticker_of(F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).alias("ticker"),
            (1 + F.floor("value") % 10).cast("long").alias("quantity"),
            (F.col("value") + 10).alias("price"),
            F.col("ts").cast("timestamp").alias("executed_at"), F.col("ts").cast("date").alias("market_date"))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            ticker_of(F.col("user_id")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"), (1 + F.col("event_id") % 7).alias("size"),
            F.col("event_id").alias("tick_id"))

    @cached_property
    def news(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", F.split("text", "\n").getItem(0).alias("title"), F.col("text").alias("content"), "lang", "source",
            F.when(F.col("doc_id") % 3 == 0, "company").when(F.col("doc_id") % 3 == 1, "industry")
            .otherwise("macro").alias("category"))
