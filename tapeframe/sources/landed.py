"""Landed rows as providers deliver them, derived from the market tables.

They carry what the cleaning jobs must repair: padded tickers, dates with times,
swapped highs and lows, missing volumes, two sources for one fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.sources.driver import Market

ITEMS = {
    "revenue": "income_statement", "gross_profit": "income_statement", "ebit": "income_statement",
    "interest_expense": "income_statement", "profit_before_tax": "income_statement",
    "net_income": "income_statement", "eps": "income_statement", "total_assets": "balance_sheet",
    "equity": "balance_sheet", "total_liabilities": "balance_sheet",
    "cash_and_cash_equivalents": "balance_sheet", "current_assets": "balance_sheet",
    "current_liabilities": "balance_sheet", "short_term_borrowings": "balance_sheet",
    "long_term_borrowings": "balance_sheet", "operating_cash_flow": "cash_flow",
    "depreciation": "cash_flow", "amortization": "cash_flow",
}
NUMBER = "cast(substr(ticker, 2) as bigint)"


def cents(name: str) -> F.Column:
    return F.floor(F.col(name) * 100) / 100.0


def prices(bars: DataFrame) -> DataFrame:
    """Daily rows of two sources; the second repeats every fifth day of the month.

    Both sources come out of one pass over the bars.
    """
    day = F.dayofmonth("date")
    copies = F.when(day % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    base = bars.select("ticker", "date", day.alias("day"), *[cents(c).alias(c) for c in ("open", "high", "low", "close")],
                       "volume", F.explode(copies).alias("copy"))
    first = F.col("copy") == 1
    swapped = first & (F.col("day") == 13)
    return base.select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
        F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("date"), "open",
        F.when(swapped, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swapped, F.col("high")).otherwise(F.col("low")).alias("low"), "close",
        F.when(~first, F.col("volume") + 1).when(F.col("day") != 17, F.col("volume")).alias("volume"),
        F.when(~first, "vnstock VCI").when(F.col("day") % 2 == 0, "DNSE").otherwise("vnstock KBS").alias("source"))


def financials(annual: DataFrame) -> DataFrame:
    """Long statement rows: a primary source with holes and a second one that sometimes disagrees."""
    names = list(ITEMS)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("item_code"))
    statement = F.create_map(*[F.lit(x) for pair in ITEMS.items() for x in pair])
    long = annual.unpivot(["ticker", "fiscal_year", "period_end"], names, "item_code", "value").select(
        "ticker", statement[F.col("item_code")].alias("statement"), "fiscal_year", "period_end",
        "item_code", number.alias("item_no"), "value", F.expr(NUMBER).alias("num"))
    year, shift = F.col("fiscal_year"), F.col("num") + F.col("fiscal_year")
    rows = long.select("*", F.explode(F.array(F.lit("DNSE"), F.lit("vnstock VCI"))).alias("source"))
    first = F.col("source") == "DNSE"
    rows = rows.filter(~first | ((shift + F.col("item_no")) % 3 != 0))
    return rows.select(
        "ticker", "statement",
        F.when(year % 3 == 0, F.concat(year.cast("string"), F.lit(".0"))).otherwise(year.cast("string")).alias("report_period"),
        F.lit("annual").alias("period_type"), F.when(~first & (year % 2 == 0), F.date_add("period_end", 60)).alias("published_date"),
        "item_code", F.when(~first & (shift % 5 == 0), F.col("value") * 1.05).otherwise(F.col("value")).alias("value"),
        "source", "fiscal_year")


def action_events(actions: DataFrame) -> DataFrame:
    """Provider events with codes and bilingual titles, each as a padded date and free text."""
    kind = F.col("action_type")
    even = F.expr(NUMBER) % 2 == 0

    def title(vi: str, en: str):
        return F.when(even, vi).otherwise(en)

    text = (F.when(kind == "cash_dividend", title("Trả cổ tức bằng tiền mặt", "Cash dividend payment"))
            .when(kind == "stock_dividend", title("Trả cổ tức bằng  cổ phiếu", "Stock dividend"))
            .when(kind == "stock_split", title("Tách cổ phiếu", "Stock split"))
            .when(kind == "rights_issue", title("Thực hiện quyền mua, giá 10,500 đồng", "Rights issue"))
            .otherwise(title("Phát hành cổ phiếu riêng lẻ", "Private placement")))
    return actions.select(
        "ticker", F.concat(F.col("ex_date").cast("string"), F.lit(" 09:00:00")).alias("exright_date"),
        F.when((kind == "cash_dividend") & even, "div").when(kind == "capital_increase", "ISS").alias("event_code"),
        text.alias("event_title"),
        F.coalesce("stock_ratio", "split_ratio", "rights_ratio").alias("exercise_ratio"),
        F.coalesce("cash_dividend", "rights_price").alias("value_per_share"))


class Landed:
    """The landed tables of one market folder."""

    def __init__(self, market: Market):
        self.market = market

    def prices(self) -> DataFrame:
        return prices(self.market.bars)

    def financials(self) -> DataFrame:
        return financials(self.market.fin_wide)

    def action_events(self) -> DataFrame:
        return action_events(self.market.actions)
