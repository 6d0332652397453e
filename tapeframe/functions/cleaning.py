"""Column steps of the cleaning jobs over landed tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeframe.functions.numeric import finite, first_match

# Source preference when two rows describe the same thing.
SOURCE_PRIORITY = [("DNSE", 0), ("vnfinancialdata", 10), ("vnstock KBS", 20), ("KBS", 20),
                   ("vnstock VCI", 30), ("VCI", 30)]

# Item ids of each provider and their canonical codes; ids not listed stay as they are.
LOCAL_ITEMS = {
    "is_doanh_so_thuan": "revenue",
    "is_gia_von_hang_ban": "cogs",
    "is_lai_gop": "gross_profit",
    "is_ebit": "ebit",
    "is_trong_do_chi_phi_lai_vay": "interest_expense",
    "is_lai_lo_rong_truoc_thue": "profit_before_tax",
    "is_loi_nhuan_cua_co_dong_cua_cong_ty_me": "net_income",
    "is_lai_co_ban_tren_co_phieu": "eps",
    "bs_tong_tai_san": "total_assets",
    "bs_von_chu_so_huu_4d280b22": "equity",
    "bs_tien_va_tuong_duong_tien": "cash_and_cash_equivalents",
    "bs_tai_san_ngan_han": "current_assets",
    "bs_no_ngan_han": "current_liabilities",
    "bs_vay_ngan_han": "short_term_borrowings",
    "bs_vay_dai_han": "long_term_borrowings",
    "bs_no_phai_tra": "total_liabilities",
    "cf_luu_chuyen_tien_thuan_tu_cac_hoat_dong_san_xuat_kinh_doanh": "operating_cash_flow",
    "cf_tien_mua_tai_san_co_dinh_va_cac_tai_san_dai_han_khac": "capex",
    "cf_khau_hao_tscd": "depreciation",
    "cf_phan_bo_loi_the_thuong_mai": "amortization",
}
ENGLISH_ITEMS = {
    "net_revenue": "revenue",
    "cost_of_goods_sold": "cogs",
    "operating_profit": "ebit",
    "of_which_interest_expense": "interest_expense",
    "profit_after_tax_for_shareholders_of_parent_company": "net_income",
    "earnings_per_share": "eps",
    "basic_earnings_per_share": "eps",
    "owners_equity": "equity",
    "total_owners_equity": "equity",
    "short_term_borrowings_and_financial_leases": "short_term_borrowings",
    "long_term_borrowings_and_financial_leases": "long_term_borrowings",
    "liabilities": "total_liabilities",
    "payment_for_fixed_assets_constructions_and_other_long_term_assets": "capex",
    "depreciation_of_fixed_assets_and_investment_properties": "depreciation",
}

# Detail codes, their canonical codes and the statement each belongs to; other codes are not taken.
DETAIL_ITEMS = {
    "REVENUE": ("revenue", "income_statement"),
    "NET_REVENUE": ("revenue", "income_statement"),
    "COST_OF_GOODS_SOLD": ("cogs", "income_statement"),
    "GROSS_PROFIT": ("gross_profit", "income_statement"),
    "EBIT": ("ebit", "income_statement"),
    "INTEREST_EXPENSE": ("interest_expense", "income_statement"),
    "PROFIT_BEFORE_TAX": ("profit_before_tax", "income_statement"),
    "PROFIT_AFTER_TAX_PARENT_COMPANY": ("net_income", "income_statement"),
    "EPS": ("eps", "income_statement"),
    "TOTAL_ASSETS": ("total_assets", "balance_sheet"),
    "OWNERS_EQUITY": ("equity", "balance_sheet"),
    "CASH_AND_CASH_EQUIVALENTS": ("cash_and_cash_equivalents", "balance_sheet"),
    "SHORT_TERM_ASSETS": ("current_assets", "balance_sheet"),
    "SHORT_TERM_LIABILITIES": ("current_liabilities", "balance_sheet"),
    "SHORT_TERM_BORROWINGS": ("short_term_borrowings", "balance_sheet"),
    "LONG_TERM_BORROWINGS": ("long_term_borrowings", "balance_sheet"),
    "TOTAL_LIABILITIES": ("total_liabilities", "balance_sheet"),
    "ACCOUNTS_PAYABLE": ("accounts_payable", "balance_sheet"),
    "CASH_FLOW": ("operating_cash_flow", "cash_flow"),
    "CAPEX": ("capex", "cash_flow"),
    "DEPRECIATION": ("depreciation", "cash_flow"),
    "AMORTIZATION": ("amortization", "cash_flow"),
}

# Provider ratio names and our column names.
RATIO_FIELDS = {
    "marketShare": "market_share", "totalAssets": "total_assets", "eps": "eps_ttm", "pe": "pe", "ps": "ps",
    "pb": "pb", "beta": "beta", "profitGrowth": "profit_growth_qoq", "roe": "roe_ttm", "roa": "roa_ttm",
    "grossMargin": "gross_margin_ttm", "debtEquityRatio": "debt_equity_ratio",
    "inventoryGrowth": "inventory_growth_qoq", "freeFloatRatio": "free_float_ratio",
    "dividendYield": "dividend_yield", "bookValue": "book_value_per_share", "revenue": "revenue_ttm",
    "profit": "net_income_ttm", "capitalization": "market_cap",
}

MISSING_WORDS = ("", "nan", "none", "nat")


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1.

    Only text that shows the marks, fits Latin-1 and turns into valid UTF-8 is changed.
    """
    suspect = text.rlike("[ÃÂÆ]") & text.rlike(r"^[\x00-\xFF]*$")
    redone = F.encode(text, "ISO-8859-1").cast("string")
    return F.when(suspect, F.when(F.is_valid_utf8(redone), redone).otherwise(text)).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), text)


def normalize_ticker(text: Column) -> Column:
    return F.upper(F.trim(text))


def coerce_numeric(text: Column) -> Column:
    """Text to double; thousands commas allowed, anything unreadable or infinite is missing."""
    return finite(F.regexp_replace(F.trim(text), ",", "").try_cast("double"))


def round_to_int(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def date_prefix(text: Column) -> Column:
    """Date from the first ten characters, so dates and timestamps may be mixed."""
    day = F.substring(F.trim(text), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def parse_percent(text: Column) -> Column:
    """'12%' is 0.12; a wrapped {"value": x} counts as x."""
    inner = F.coalesce(F.when(F.trim(text).startswith("{"), F.get_json_object(text, "$.value")), text)
    inner = F.trim(inner)
    share = F.regexp_replace(inner, "%$", "").try_cast("double") / 100.0
    return F.when(inner.endswith("%"), finite(share)).otherwise(coerce_numeric(inner))


def parse_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "true", True).when(low == "false", False)


def fiscal_year(period: Column) -> Column:
    text = F.trim(period)
    return F.when(text.rlike(r"^\d{4}(-Q[1-4])?$"), F.substring(text, 1, 4).try_cast("long"))


def fiscal_quarter(period: Column) -> Column:
    text = F.trim(period)
    return F.when(text.rlike(r"^\d{4}-Q[1-4]$"), F.substring(text, 7, 1).try_cast("long"))


def period_end(period: Column) -> Column:
    """Last day of the year or quarter; anything else has none."""
    year, quarter = fiscal_year(period), fiscal_quarter(period)
    month = F.coalesce(quarter * 3, F.lit(12))
    return F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))


def normalize_report_period(text: Column, period_type: str) -> Column:
    """Provider period labels to 'YYYY' or 'YYYY-Qn'; unreadable labels are kept."""
    up = F.upper(F.trim(text))
    if period_type == "annual":
        year = F.regexp_extract(up, r"((?:19|20)\d{2})", 1)
        return F.when(year != "", year).otherwise(up)
    lead, trail = r"Q([1-4])\s*[/\-]\s*((?:19|20)\d{2})", r"((?:19|20)\d{2})\s*[/\-]\s*Q([1-4])"
    return (
        F.when(up.rlike(lead), F.concat(F.regexp_extract(up, lead, 2), F.lit("-Q"), F.regexp_extract(up, lead, 1)))
        .when(up.rlike(trail), F.concat(F.regexp_extract(up, trail, 1), F.lit("-Q"), F.regexp_extract(up, trail, 2)))
        .otherwise(up))


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_item_code(raw: Column, items: dict[str, str]) -> Column:
    """Exact lookup in one provider's ids, so similarly named subtotals never merge; unlisted ids stay."""
    code = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    code = F.regexp_replace(code, " ", "_") if items is ENGLISH_ITEMS else code
    return F.coalesce(F.try_element_at(_lookup(items), code), F.when(code != "", code), F.lit("unknown_item"))


def detail_item(raw: Column) -> Column:
    """Canonical code and statement of a detail code; null where it is not taken."""
    code = F.upper(F.trim(raw))
    item = F.try_element_at(_lookup({k: v[0] for k, v in DETAIL_ITEMS.items()}), code)
    statement = F.try_element_at(_lookup({k: v[1] for k, v in DETAIL_ITEMS.items()}), code)
    return F.when(item.isNotNull(), F.struct(item.alias("item_code"), statement.alias("statement")))


def source_priority(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return first_match([(low.startswith(prefix.lower()), rank) for prefix, rank in SOURCE_PRIORITY], 99).cast("long")


def number_token(value: Column, text: Column | None = None) -> Column:
    """Eight decimals with trailing zeros removed; missing is empty.  ``text`` is the value as Spark writes it.

    A plain number of at most eight decimals stays as it is written, and a large whole one is written as a whole number:
    that is the same text, and it spares nearly all values the formatter and its patterns.
    """
    text = value.cast("string") if text is None else text
    plain = ~F.contains(text, F.lit("E")) & (F.length(text) - F.instr(text, ".") <= 8)  # no exponent: 0, or 0.001 to below 10 million
    whole = (F.abs(value) >= 1e7) & (F.abs(value) < 1e15) & (value == F.floor(value))
    formatted = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", value), "0+$", ""), r"\.$", "")
    return (F.when(finite(value).isNull(), "").when(plain, F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text))
            .when(whole, value.cast("long").cast("string")).otherwise(formatted))


def row_checksum(ticker: Column, date: Column, numbers: list[Column]) -> Column:
    """The tokens are one expression over an array: written out for every number they make a method that the JVM does not compile."""
    parts = [F.coalesce(normalize_ticker(ticker), F.lit("")), F.coalesce(date.cast("string"), F.lit(""))]
    values = F.array(*[n.cast("double") for n in numbers])
    return F.sha2(F.concat_ws("|", *parts, F.zip_with(values, values.cast("array<string>"), number_token)), 256)


def financial_unit(item_code: Column) -> Column:
    return F.when(item_code == "eps", "VND/share").otherwise("VND")


def price_unit_value(raw: Column, reference: Column) -> Column:
    """Bring an amount to the unit of the reference price."""
    return F.when((reference < 1000) & (raw >= 1000), raw / 1000.0).otherwise(raw)


def percent_ratio(ratio: Column) -> Column:
    """Ratios above one are percentages."""
    return F.when(ratio > 1, ratio / 100.0).otherwise(ratio)


def first_present(*values: Column) -> Column:
    """First value that is not null, blank or a word for missing."""
    return F.coalesce(*[F.when(~F.lower(F.trim(v.cast("string"))).isin(*MISSING_WORDS), v) for v in values])


def _fold_table() -> tuple[str, str]:
    """Accented letters with a one-letter base, then the marks to delete, by Unicode's own rule."""
    source, target = [], []
    for point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source + [chr(p) for p in range(0x300, 0x370)]), "".join(target)


def ascii_fold(text: Column) -> Column:
    """Drop accents, lower the case, squeeze spaces."""
    source, target = _fold_table()
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), source, target)), r"\s+", " "))


# Ordered rules of the event classifier; the first rule that holds wins.
ACTION_RULES = [
    ("cash_dividend", "DIV", ("co tuc bang tien", "cash dividend")),
    ("stock_split", None, ("tach co phieu", "stock split")),
    ("rights_issue", None, ("quyen mua", "rights issue")),
    ("stock_dividend", None, ("co tuc bang co phieu", "stock dividend")),
    ("bonus_shares", None, ("co phieu thuong", "bonus")),
    ("capital_increase", "ISS", ("phat hanh co phieu", "capital increase")),
]
RIGHTS_PRICE = r"(?:gia|price)[^0-9]{0,15}([0-9][0-9.,]*)"


def action_type(code: Column, description: Column) -> Column:
    """``description`` is folded text."""
    rules = []
    for name, event_code, phrases in ACTION_RULES:
        hit = description.contains(phrases[0]) | description.contains(phrases[1])
        if event_code:
            hit = hit | (F.upper(F.coalesce(code, F.lit(""))) == event_code)
        rules.append((hit, name))
    return first_match(rules)


def action_fields(kind: Column, ratio: Column, cash: Column, description: Column) -> dict[str, Column]:
    priced = F.regexp_extract(description, RIGHTS_PRICE, 1)
    return {
        "cash_dividend": F.when(kind == "cash_dividend", cash),
        "stock_ratio": F.when(kind.isin("stock_dividend", "bonus_shares", "capital_increase"), ratio),
        "split_ratio": F.when(kind == "stock_split", ratio),
        "rights_ratio": F.when(kind == "rights_issue", ratio),
        "rights_price": F.when(kind == "rights_issue", F.when(priced != "", coerce_numeric(priced)).otherwise(cash)),
    }


def ohlc_valid() -> Column:
    """Complete, non-negative and internally consistent bar."""
    names = ("open", "high", "low", "close")
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull() & F.coalesce(F.col(n) >= 0, F.lit(False))
    ordered = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    return complete & F.coalesce(ordered, F.lit(False))


def volume_valid() -> Column:
    return F.col("volume").isNull() | (F.col("volume") >= 0)


def adjusted_quote(raw: Column, adjusted_close: Column, raw_close: Column) -> Column:
    return F.when((raw > 0) & (adjusted_close > 0) & (raw_close > 0), raw * adjusted_close / raw_close)
