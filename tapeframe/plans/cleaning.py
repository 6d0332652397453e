"""Column steps and cleaning jobs over landed tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeframe.functions import cleaning as c
from tapeframe.operators import clean
from tapeframe.operators.ranking import first_per_key, grouped_median
from tapeframe.plans.fundamentals import snapshot
from tapeframe.plans.registry import query, rounded, view
from tapeframe.plans.windows import W
from tapeframe.sources import landed as L
from tapeframe.sources.driver import Market

_C = ", ".join(f"floor({x} * 100) / 100 AS {x}" for x in ("open", "high", "low", "close"))
view("ld_prices", f"""
SELECT * FROM (
  SELECT concat(' ', lower(ticker), ' ') AS ticker, concat(CAST(date AS VARCHAR), ' 00:00:00') AS date, open,
         CASE WHEN day = 13 THEN low ELSE high END AS high, CASE WHEN day = 13 THEN high ELSE low END AS low, close,
         CASE WHEN day <> 17 THEN volume END AS volume, CASE WHEN day % 2 = 0 THEN 'DNSE' ELSE 'vnstock KBS' END AS source
  FROM (SELECT ticker, date, day(date) AS day, {_C}, volume FROM fx_bars)
  UNION ALL
  SELECT concat(' ', lower(ticker), ' '), concat(CAST(date AS VARCHAR), ' 00:00:00'), open, high, low, close, volume + 1,
         'vnstock VCI' FROM (SELECT ticker, date, day(date) AS day, {_C}, volume FROM fx_bars) WHERE day % 5 = 0)
""")


def sql_priority(column: str) -> str:
    return (f"CASE WHEN lower({column}) LIKE 'dnse%' THEN 0 WHEN lower({column}) LIKE 'vnfinancialdata%' THEN 10 "
            f"WHEN lower({column}) LIKE 'vnstock kbs%' OR lower({column}) LIKE 'kbs%' THEN 20 "
            f"WHEN lower({column}) LIKE 'vnstock vci%' OR lower({column}) LIKE 'vci%' THEN 30 ELSE 99 END")


def sql_token(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL OR NOT isfinite({column}) THEN '' ELSE "
            f"regexp_replace(regexp_replace(printf('%.8f', CAST({column} AS DOUBLE)), '0+$', ''), '\\.$', '') END")


def sql_checksum(prefix: str = "") -> str:
    tokens = ", ".join(sql_token(prefix + n) for n in ("open", "high", "low", "close", "volume"))
    return f"sha256(concat_ws('|', upper(trim({prefix}ticker)), CAST({prefix}date AS VARCHAR), {tokens}))"


view("ld_typed", f"""
SELECT upper(trim(ticker)) AS ticker, CAST(substr(date, 1, 10) AS DATE) AS date, open, high, low, close, volume, source,
       {sql_priority('source')} AS source_priority FROM ld_prices
""")
view("cl_prices", f"""
SELECT *, ohlc_valid AND volume_valid AS analysis_ready, close * volume AS estimated_trading_value,
       CASE WHEN source = 'DNSE' THEN row_checksum END AS source_checksum
FROM (SELECT *, {sql_checksum()} AS row_checksum,
             open >= 0 AND high >= 0 AND low >= 0 AND close >= 0 AND high >= open AND high >= close AND high >= low
               AND low <= open AND low <= close AS ohlc_valid, volume IS NULL OR volume >= 0 AS volume_valid
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY source_priority, source, close, volume) AS rn
            FROM ld_typed) WHERE rn = 1)
""")


@query("repair_mojibake", "SELECT doc_id, text FROM documents")
def repair_mojibake(spark, folder):
    """Every second text arrives as UTF-8 read as Latin-1; all must come back whole."""
    docs = Market(spark, folder).table("documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    seen = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("text")).alias("text"))
    return seen.select("doc_id", c.repair_mojibake(F.col("text")).alias("text"))


@query("blank_to_null", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 <> 0 AND regexp_matches(text, '\\S') THEN text END AS text FROM documents
""")
def blank_to_null(spark, folder):
    docs = Market(spark, folder).table("documents")
    seen = F.when(F.col("doc_id") % 4 == 0, " \t ").when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))
    return docs.select("doc_id", c.blank_to_null(seen).alias("text"))


@query("normalize_ticker", "SELECT ticker, count(*) AS rows FROM fx_bars GROUP BY ticker")
def normalize_ticker(spark, folder):
    padded = Market(spark, folder).bars.select(F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("t"))
    return padded.groupBy(c.normalize_ticker(F.col("t")).alias("ticker")).agg(F.count("*").alias("rows"))


@query("coerce_numeric", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN isfinite(v) THEN v END AS value FROM (
  SELECT *, TRY_CAST(replace(trim(t), ',', '') AS DOUBLE) AS v FROM (
    SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_linenumber
      WHEN 1 THEN format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR)
      WHEN 3 THEN 'n/a' WHEN 4 THEN '  ' WHEN 5 THEN 'inf' WHEN 6 THEN 'NaN'
      ELSE concat(' ', CAST(CAST(l_quantity AS INT) AS VARCHAR), '.25') END AS t FROM lineitem))
""")
def coerce_numeric(spark, folder):
    n = F.col("l_linenumber")
    whole = F.col("l_quantity").cast("int").cast("string")
    text = (F.when(n == 1, F.format_number(F.floor("l_extendedprice"), 0)).when(n == 2, whole).when(n == 3, "n/a")
            .when(n == 4, "  ").when(n == 5, "inf").when(n == 6, "NaN").otherwise(F.concat(F.lit(" "), whole, F.lit(".25"))))
    return Market(spark, folder).table("lineitem").select(
        "l_orderkey", F.col("l_linenumber"), "l_extendedprice", c.coerce_numeric(text).alias("value"))


@query("round_to_int", """
SELECT l_orderkey, l_linenumber, l_quantity / 2 AS half, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded FROM lineitem
""")
def round_to_int(spark, folder):
    half = F.col("l_quantity") / 2
    return Market(spark, folder).table("lineitem").select(
        "l_orderkey", "l_linenumber", half.alias("half"), c.round_to_int(half).alias("rounded"))


@query("date_prefix", """
SELECT ticker, date AS landed, CASE WHEN day(date) <> 9 THEN date END AS parsed FROM fx_bars
""")
def date_prefix(spark, folder):
    bars = Market(spark, folder).bars
    text = F.col("date").cast("string")
    day = F.dayofmonth("date")
    seen = F.when(day == 9, F.concat(F.lit("x"), text)).when(day % 2 == 0, text).otherwise(F.concat(text, F.lit(" 08:30:00")))
    return bars.select("ticker", F.col("date").alias("landed"), c.date_prefix(seen).alias("parsed"))


@query("parse_percent", """
SELECT ticker, date, CASE day(date) % 4 WHEN 0 THEN CAST(volume AS BIGINT) / 100 WHEN 1 THEN CAST(volume AS BIGINT) + 0.5
       WHEN 2 THEN volume END AS value FROM fx_bars
""")
def parse_percent(spark, folder):
    bars = Market(spark, folder).bars
    whole, day = F.col("volume").cast("long").cast("string"), F.dayofmonth("date") % 4
    text = (F.when(day == 0, F.concat(whole, F.lit("%"))).when(day == 1, F.concat(F.lit('{"value": '), whole, F.lit(".5}")))
            .when(day == 2, whole).otherwise("x%"))
    return bars.select("ticker", "date", c.parse_percent(text).alias("value"))


@query("parse_bool", """
SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false END AS available FROM events
""")
def parse_bool(spark, folder):
    text = F.when(F.col("event_type") == "click", "True").when(F.col("event_type") == "view", "FALSE").otherwise(F.col("event_type"))
    return Market(spark, folder).table("events").select("event_id", c.parse_bool(text).alias("available"))


_PERIODS = "CASE day(date) % 3 WHEN 0 THEN CAST(year(date) AS VARCHAR) WHEN 1 THEN concat(year(date), '-Q', quarter(date)) ELSE concat('FY', year(date)) END"


def _period_labels(bars):
    year, day = F.year("date").cast("string"), F.dayofmonth("date") % 3
    return F.when(day == 0, year).when(day == 1, F.concat(year, F.lit("-Q"), F.quarter("date").cast("string"))).otherwise(
        F.concat(F.lit("FY"), year))


@query("parse_period", f"""
SELECT ticker, date, {_PERIODS} AS report_period, CASE WHEN day(date) % 3 < 2 THEN year(date) END AS fiscal_year,
       CASE WHEN day(date) % 3 = 1 THEN quarter(date) END AS fiscal_quarter,
       CASE day(date) % 3 WHEN 0 THEN make_date(year(date), 12, 31) WHEN 1 THEN last_day(make_date(year(date), 3 * quarter(date), 1)) END AS period_end
FROM fx_bars
""")
def parse_period(spark, folder):
    bars = Market(spark, folder).bars
    rows = bars.select("ticker", "date", _period_labels(bars).alias("report_period"))
    period = F.col("report_period")
    return rows.select("ticker", "date", "report_period", c.fiscal_year(period).alias("fiscal_year"),
                       c.fiscal_quarter(period).alias("fiscal_quarter"), c.period_end(period).alias("period_end"))


@query("normalize_report_period", """
SELECT ticker, date, CASE WHEN day(date) % 4 = 3 THEN 'H1' ELSE concat(year(date), '-Q', quarter(date)) END AS quarterly,
       CAST(year(date) AS VARCHAR) AS annual FROM fx_bars
""")
def normalize_report_period(spark, folder):
    year, quarter, day = F.year("date").cast("string"), F.quarter("date").cast("string"), F.dayofmonth("date") % 4
    label = (F.when(day == 0, F.concat(F.lit("q"), quarter, F.lit("/"), year))
             .when(day == 1, F.concat(year, F.lit(" - Q"), quarter))
             .when(day == 2, F.concat(F.lit(" Q"), quarter, F.lit(" - "), year)).otherwise(F.lit(" h1 ")))
    return Market(spark, folder).bars.select(
        "ticker", "date", c.normalize_report_period(label, "quarterly").alias("quarterly"),
        c.normalize_report_period(F.concat(F.lit("FY "), year, F.lit(" audited")), "annual").alias("annual"))


view("ld_items", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {i}, '{s}')" for i, (n, s) in enumerate(L.ITEMS.items(), 1)) + ") AS t(item_code, item_no, statement)")
view("fx_fin_long", """
SELECT f.ticker, f.fiscal_year, f.period_end, f.item_code, f.value, CAST(substr(f.ticker, 2) AS BIGINT) AS num, i.item_no, i.statement
FROM (""" + " UNION ALL ".join(f"SELECT ticker, fiscal_year, period_end, '{n}' AS item_code, {n} AS value FROM fx_fin_wide"
                               for n in L.ITEMS) + """) f JOIN ld_items i ON i.item_code = f.item_code
""")


def _sql_values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in pair) + ")" for pair in pairs)


def provider_ids(items: dict[str, str]) -> dict[str, str]:
    """One provider id for each canonical code it has."""
    out: dict[str, str] = {}
    for raw, code in items.items():
        out.setdefault(code, raw)
    return out


DETAIL_OF = provider_ids({raw: code for raw, (code, _) in c.DETAIL_ITEMS.items()})
view("ld_detail", f"SELECT * FROM (VALUES {_sql_values((code, raw, c.DETAIL_ITEMS[raw][1]) for code, raw in DETAIL_OF.items())}) AS t(item_code, raw, detail_statement)")


@query("canonical_item_code", """
SELECT provider, ticker, fiscal_year, item_code, statement, count(*) AS items FROM (
  SELECT provider, ticker, fiscal_year, statement, CASE WHEN num % 10 = 3 THEN concat(CASE provider WHEN 'english' THEN 'x_' ELSE 'x ' END, item_code)
    WHEN num % 10 = 4 THEN 'unknown_item' ELSE item_code END AS item_code FROM fx_fin_long, (VALUES ('local'), ('english')) AS p(provider)
  UNION ALL SELECT 'detail', f.ticker, f.fiscal_year, d.detail_statement, f.item_code FROM fx_fin_long f JOIN ld_detail d ON d.item_code = f.item_code
  WHERE f.num % 10 NOT IN (3, 4)) GROUP BY ALL
""")
def canonical_item_code(spark, folder):
    """Ids of three providers for every statement row, in odd case and padded, to canonical codes; unlisted and blank ones too."""
    names = list(L.ITEMS)
    kinds = F.create_map(*[F.lit(x) for pair in L.ITEMS.items() for x in pair])
    long = Market(spark, folder).fin_wide.unpivot(["ticker", "fiscal_year"], names, "code", "value")
    last, code = F.expr(L.NUMBER) % 10, F.col("code")

    def seen(of: dict[str, str]):
        raw = F.create_map(*[F.lit(x) for n in names for x in (n, of.get(n, n))])[code]
        return F.when(last == 3, F.concat(F.lit("X "), code)).when(last == 4, "  ").otherwise(F.concat(F.lit(" "), F.upper(raw)))

    parts = []
    for provider, items in (("local", c.LOCAL_ITEMS), ("english", c.ENGLISH_ITEMS)):
        parts.append(F.struct(F.lit(provider).alias("provider"), c.canonical_item_code(seen(provider_ids(items)), items).alias("item_code"),
                              kinds[code].alias("statement")))
    detail = c.detail_item(seen(DETAIL_OF))
    parts.append(F.struct(F.lit("detail").alias("provider"), detail["item_code"].alias("item_code"), detail["statement"].alias("statement")))
    rows = long.select("ticker", "fiscal_year", F.explode(F.array(*parts)).alias("p")).select("ticker", "fiscal_year", "p.*").filter("item_code IS NOT NULL")
    return rows.groupBy("provider", "ticker", "fiscal_year", "item_code", "statement").agg(F.count("*").alias("items"))


@query("source_priority", f"""
SELECT source, min({sql_priority('source')}) AS priority, count(*) AS rows FROM (
  SELECT source FROM ld_prices UNION ALL SELECT concat(source, ' v2') FROM documents) GROUP BY source
""")
def source_priority(spark, folder):
    market = Market(spark, folder)
    names = L.Landed(market).prices().select("source").unionByName(
        market.table("documents").select(F.concat("source", F.lit(" v2")).alias("source")))
    return names.groupBy("source").agg(F.count("*").alias("rows")).withColumn("priority", c.source_priority(F.col("source")))


@query("row_checksum", f"SELECT ticker, date, {sql_checksum()} AS row_checksum FROM ld_typed")
def row_checksum(spark, folder):
    rows = clean.typed_prices(L.Landed(Market(spark, folder)).prices())
    return clean.with_checksums(rows).select("ticker", "date", "row_checksum")


@query("action_fingerprint", """
SELECT ticker, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(sha256(
         concat_ws('|', ticker, CAST(ex_date AS VARCHAR), action_type)), 1, 15)) AS BIGINT)) AS VARCHAR))) AS fingerprint
FROM fx_actions GROUP BY ticker
""")
def action_fingerprint(spark, folder):
    return clean.action_fingerprints(Market(spark, folder).actions.select("ticker", "ex_date", "action_type"))


@query("unit_columns", """
SELECT item_code, CASE WHEN item_code = 'eps' THEN 'VND/share' ELSE 'VND' END AS unit, count(*) AS rows FROM fx_fin_long GROUP BY ALL
""")
def unit_columns(spark, folder):
    rows = L.Landed(Market(spark, folder)).market.fin_wide.unpivot(["ticker", "fiscal_year"], list(L.ITEMS), "item_code", "value")
    return rows.groupBy("item_code", c.financial_unit(F.col("item_code")).alias("unit")).agg(F.count("*").alias("rows"))


view("ld_thousands", f"""
SELECT ticker, date, CASE WHEN even THEN open / 1000 ELSE open END AS open, CASE WHEN even THEN high / 1000 ELSE high END AS high,
       CASE WHEN even THEN low / 1000 ELSE low END AS low, CASE WHEN even THEN close / 1000 ELSE close END AS close
FROM (SELECT ticker, date, CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 AS even, {_C} FROM fx_bars)
""")


@query("unit_rescale", """
SELECT ticker, date, CASE WHEN m < 1000 THEN round(open * 1000, 4) ELSE open END AS open,
       CASE WHEN m < 1000 THEN round(high * 1000, 4) ELSE high END AS high, CASE WHEN m < 1000 THEN round(low * 1000, 4) ELSE low END AS low,
       CASE WHEN m < 1000 THEN round(close * 1000, 4) ELSE close END AS close
FROM (SELECT *, median(close) OVER (PARTITION BY ticker) AS m FROM ld_thousands)
""")
def unit_rescale(spark, folder):
    even = F.expr(L.NUMBER) % 2 == 0
    rows = Market(spark, folder).staged_bars.select("ticker", "date", *[
        F.when(even, L.cents(n) / 1000).otherwise(L.cents(n)).alias(n) for n in clean.OHLC])
    return clean.unit_rescaled(rows, grouped_median(rows, ["ticker"], "close", positive=False))


@query("estimated_value", f"""
SELECT ticker, date, round(floor(close * 100) / 100 * volume + 1e-9, 2) AS trading_value, true AS trading_value_is_estimated FROM fx_bars
""")
def estimated_value(spark, folder):
    return Market(spark, folder).bars.select(
        "ticker", "date", F.round(L.cents("close") * F.col("volume") + 1e-9, 2).alias("trading_value"),
        F.lit(True).alias("trading_value_is_estimated"))


@query("ascii_fold", """
SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS folded FROM documents
""")
def ascii_fold(spark, folder):
    return Market(spark, folder).table("documents").select("doc_id", c.ascii_fold(F.col("text")).alias("folded"))


view("cl_actions", """
SELECT ticker, ex_date, action_type, cash_dividend, CASE WHEN action_type = 'stock_dividend' THEN stock_ratio END AS stock_ratio,
       split_ratio, rights_ratio, CASE WHEN action_type = 'rights_issue' THEN
         CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 THEN 10500.0 ELSE rights_price END END AS rights_price
FROM fx_actions
""")


@query("classify_action", "SELECT * FROM cl_actions")
def classify_action(spark, folder):
    return clean.classified_actions(L.Landed(Market(spark, folder)).action_events())


@query("explode_series", """
SELECT ticker, CAST(fiscal_year AS VARCHAR) AS label, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 THEN revenue ELSE revenue + gross_profit END AS value
FROM fx_fin_wide
""")
def explode_series(spark, folder):
    """Chart payloads of a ticker's yearly series; a ticker has one point per fiscal year."""
    annual = Market(spark, folder).fin_wide
    points = annual.groupBy("ticker").agg(F.array_sort(F.collect_list(
        F.struct("fiscal_year", "revenue", "gross_profit"))).alias("s"))
    marked = F.expr(L.NUMBER) % 3 == 0
    line = lambda kind, name: F.struct(kind.alias("type"), F.col(f"s.{name}").alias("y"))
    payload = F.to_json(F.struct(
        F.transform("s.fiscal_year", lambda y: y.cast("string")).alias("x"),
        F.when(marked, "MarkUpLine").otherwise("bar").alias("type"),
        F.array(line(F.lit("line"), "revenue"), line(F.when(marked, "line").otherwise("bar"), "gross_profit")).alias("data")))
    return clean.series_payload(points.select("ticker", payload.alias("payload"))).select("ticker", "label", "value")


@query("explode_ohlc_arrays", f"""
SELECT ticker, date, round(open * k, 2) AS open, round(high * k, 2) AS high, round(low * k, 2) AS low, round(close * k, 2) AS close, volume
FROM (SELECT *, CASE WHEN close < 1000 THEN 1000 ELSE 1 END AS k FROM (
        SELECT t.*, b.volume FROM ld_thousands t JOIN fx_bars b ON b.ticker = t.ticker AND b.date = t.date))
WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND day(date) <> 13
""")
def explode_ohlc_arrays(spark, folder):
    """Parallel-array candle payloads, one per ticker and year, back to valid rows."""
    even = F.expr(L.NUMBER) % 2 == 0
    scaled = {n: F.when(even, L.cents(n) / 1000).otherwise(L.cents(n)) for n in clean.OHLC}
    rows = Market(spark, folder).bars.withColumns(scaled).withColumn(
        "low", F.when(F.dayofmonth("date") == 13, F.col("high") + 1).otherwise(F.col("low")))
    packed = rows.groupBy("ticker", F.year("date").alias("y")).agg(F.array_sort(F.collect_list(F.struct(
        F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
        F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")))).alias("s"))
    payload = F.to_json(F.struct(*[F.col(f"s.{k}").alias(k) for k in "tohlcv"]))
    return clean.ohlc_payload(packed.select("ticker", payload.alias("payload")))


_RATIO_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {v}" for v in c.RATIO_FIELDS.values()
                         if v not in ("pe", "pb", "eps_ttm", "roe_ttm", "market_cap", "net_income_ttm"))


@query("project_index_map", f"""
SELECT ticker, 'stock' AS company_type, pe, pb, eps_ttm, CAST(substr(ticker, 2) AS BIGINT) / 100 AS roe_ttm, market_cap, net_income_ttm, {_RATIO_NULLS}
FROM fx_snapshot
""")
def project_index_map(spark, folder):
    rows = snapshot(Market(spark, folder))
    indexes = F.struct(
        F.struct(F.col("pe").alias("value")).alias("pe"), F.col("pb"), F.col("eps_ttm").alias("eps"),
        F.concat(F.expr(L.NUMBER).cast("string"), F.lit("%")).alias("roe"),
        F.struct(F.col("market_cap").alias("value")).alias("capitalization"), F.col("net_income_ttm").alias("profit"))
    payload = F.to_json(F.struct(F.lit("stock").alias("companyType"), indexes.alias("indexes")))
    return clean.ratio_payload(rows.select("ticker", payload.alias("payload")))


@query("first_present", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS value FROM events
""")
def first_present(spark, folder):
    k = F.col("event_id") % 3
    primary = F.when(k == 0, F.col("event_type")).when(k == 1, " NaN ").otherwise("")
    return Market(spark, folder).table("events").select(
        "event_id", c.first_present(primary, F.lit(None).cast("string"), F.col("user_id").cast("string")).alias("value"))


@query("price_unit_value", """
SELECT ticker, date, CASE WHEN low < 1000 AND trading_value >= 1000 THEN trading_value / 1000 ELSE trading_value END AS cash,
       CASE WHEN volume > 1 THEN volume / 100 ELSE volume END AS ratio FROM fx_bars
""")
def price_unit_value(spark, folder):
    return Market(spark, folder).bars.select(
        "ticker", "date", c.price_unit_value(F.col("trading_value"), F.col("low")).alias("cash"),
        c.percent_ratio(F.col("volume")).alias("ratio"))


view("fx_last_bar", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fx_bars) WHERE rn = 1")


@query("display_valuation", """
SELECT s.ticker, round(coalesce(CASE WHEN pe > 0 THEN pe END, CASE WHEN eps_ttm > 0 THEN close / eps_ttm END) + 1e-9, 6) AS pe_ttm,
       CASE WHEN pe > 0 THEN 'provider_pe' WHEN eps_ttm > 0 THEN 'latest_eod_close_divided_by_eps_ttm' ELSE 'unavailable' END AS pe_source
FROM fx_snapshot s JOIN fx_last_bar b ON b.ticker = s.ticker
""")
def display_valuation(spark, folder):
    market = Market(spark, folder)
    last = first_per_key(market.bars, ["ticker"], [F.col("date").desc()]).select("ticker", "close")
    return clean.display_valuation(snapshot(market).join(last, "ticker")).select("ticker", *rounded(["pe_ttm"], 6), "pe_source")


@query("session_shape", f"""
SELECT ticker, date, close / (1 + r) AS previous_close, (high - low) / nullif(close / (1 + r), 0) AS range_share,
       (close - low) / nullif(high - low, 0) AS close_location,
       CASE WHEN (close - low) / nullif(high - low, 0) >= 0.8 THEN 'near_high' WHEN (close - low) / nullif(high - low, 0) <= 0.2 THEN 'near_low' ELSE 'middle' END AS close_label
FROM (SELECT *, close / lag(close) {W}) - 1 AS r FROM fx_bars)
""")
def session_shape(spark, folder):
    from tapeframe.operators.windows import by_date
    rows = Market(spark, folder).bars.withColumn("return_1d", F.col("close") / F.lag("close").over(by_date()) - 1)
    return clean.session_shape(rows).select("ticker", "date", "previous_close", "range_share", "close_location", "close_label")


@query("adjusted_quote", """
SELECT ticker, date, CASE WHEN open > 0 AND close > 0 THEN open * (close * 0.9) / close END AS quote FROM fx_bars
""")
def adjusted_quote(spark, folder):
    return Market(spark, folder).bars.select(
        "ticker", "date", c.adjusted_quote(F.col("open"), F.col("close") * 0.9, F.col("close")).alias("quote"))


# --- filters and predicates -------------------------------------------------

@query("ohlc_valid", "SELECT ticker, date, ohlc_valid, volume_valid FROM cl_prices")
def ohlc_valid(spark, folder):
    return clean.prices(L.Landed(Market(spark, folder)).prices()).select("ticker", "date", "ohlc_valid", "volume_valid")


@query("analysis_ready", "SELECT ticker, date, close FROM cl_prices WHERE analysis_ready")
def analysis_ready(spark, folder):
    return clean.prices(L.Landed(Market(spark, folder)).prices()).filter("analysis_ready").select("ticker", "date", "close")


@query("universe_filter", """
SELECT s_suppkey, upper(concat(chr(CAST(65 + s_suppkey % 26 AS INT)), chr(CAST(65 + s_suppkey % 7 AS INT)), CAST(s_suppkey % 10 AS VARCHAR))) AS symbol,
       CASE WHEN s_nationkey % 3 = 2 THEN 'HNX' ELSE 'HOSE' END AS exchange
FROM supplier WHERE s_nationkey % 3 <> 1 AND s_suppkey % 4 <> 0
""")
def universe_filter(spark, folder):
    """Listed stocks: three letters or digits, on one of the two exchanges."""
    k = F.col("s_suppkey")
    symbol = F.concat(F.char(65 + k % 26), F.char(65 + k % 7), (k % 10).cast("string"))
    rows = Market(spark, folder).table("supplier").select(
        k, F.lower(F.when(k % 4 == 0, F.concat(symbol, F.lit("W"))).otherwise(symbol)).alias("symbol"),
        F.when(F.col("s_nationkey") % 3 == 0, "hsx").when(F.col("s_nationkey") % 3 == 1, "UPCOM").otherwise("HNX").alias("floor"),
        F.lit("stock").alias("type"))
    return clean_universe(rows)


def clean_universe(rows):
    exchange = F.when(F.upper(F.trim("floor")).isin("HSX", "HOSE"), "HOSE").otherwise(F.upper(F.trim("floor")))
    out = rows.select("s_suppkey", F.upper(F.trim("symbol")).alias("symbol"), exchange.alias("exchange"), F.upper("type").alias("type"))
    return out.filter(F.col("symbol").rlike("^[A-Z0-9]{3}$") & F.col("exchange").isin("HOSE", "HNX")
                      & (F.coalesce(F.col("type"), F.lit("STOCK")) == "STOCK")).select("s_suppkey", "symbol", "exchange")


@query("suspicious_move", f"""
SELECT ticker, coalesce(bool_or(NOT ok), false) OR coalesce(bool_or(abs(change) > 0.5), false) AS needs_fallback
FROM (SELECT ticker, ohlc_valid AS ok, close / nullif(lag(close) {W}), 0) - 1 AS change FROM cl_prices) GROUP BY ticker
""")
def suspicious_move(spark, folder):
    return needs_fallback(clean.prices(L.Landed(Market(spark, folder)).prices()))


def needs_fallback(rows):
    change = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1
    return rows.withColumn("_c", change).groupBy("ticker").agg(
        (F.coalesce(F.bool_or(~F.col("ohlc_valid")), F.lit(False))
         | F.coalesce(F.bool_or(F.abs("_c") > 0.5), F.lit(False))).alias("needs_fallback"))


# --- jobs ---------------------------------------------------------------------

@query("job_companies", """
SELECT ticker, company_name, exchange, CASE WHEN num % 6 <> 0 THEN make_date(CAST(1990 + num % 20 AS INT), 6, 15) END AS listing_date,
       CASE WHEN num % 5 <> 0 THEN CAST(num * 1000 AS DOUBLE) END AS market_cap
FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS num FROM fx_companies)
""")
def job_companies(spark, folder):
    """Company metadata landed twice per ticker; the later landing wins."""
    rows = Market(spark, folder).companies
    num = F.expr(L.NUMBER)
    text = F.concat((1990 + num % 20).cast("string"), F.lit("-06-15"))
    landed = rows.select(
        F.concat(F.lower("ticker"), F.lit(" ")).alias("ticker"), "company_name", "exchange",
        F.when(num % 6 == 0, " ").when(num % 2 == 0, text).otherwise(F.concat(text, F.lit("T00:00:00"))).alias("listing_date"),
        F.when(num % 5 == 0, "n/a").otherwise(F.format_number(num * 1000, 0)).alias("market_cap"), F.lit(2).alias("landed_at"))
    older = landed.withColumns({"company_name": F.lit("old name"), "landed_at": F.lit(1)})
    return clean.companies(landed.unionByName(older)).drop("landed_at")


view("ld_fin", """
SELECT ticker, statement, CASE WHEN fiscal_year % 3 = 0 THEN concat(fiscal_year, '.0') ELSE CAST(fiscal_year AS VARCHAR) END AS report_period,
       'annual' AS period_type, published_date, item_code, value, source, fiscal_year FROM (
  SELECT *, 'DNSE' AS source, CAST(NULL AS DATE) AS published_date FROM fx_fin_long WHERE (num + fiscal_year + item_no) % 3 <> 0
  UNION ALL
  SELECT * REPLACE (CASE WHEN (num + fiscal_year) % 5 = 0 THEN value * 1.05 ELSE value END AS value), 'vnstock VCI',
         CASE WHEN fiscal_year % 2 = 0 THEN CAST(period_end + INTERVAL 60 DAY AS DATE) END FROM fx_fin_long)
""")
view("cl_fin", """
SELECT *, value IS NOT NULL AS row_valid, published_date IS NOT NULL AS point_in_time_ready, make_date(fiscal_year, 12, 31) AS period_end,
       CASE WHEN item_code = 'eps' THEN 'VND/share' ELSE 'VND' END AS unit
FROM (SELECT * REPLACE (CAST(fiscal_year AS VARCHAR) AS report_period),
             row_number() OVER (PARTITION BY ticker, statement, fiscal_year, item_code ORDER BY source, value NULLS LAST) AS rn FROM ld_fin)
WHERE rn = 1
""")


@query("job_financials", """
SELECT ticker, statement, report_period, item_code, value, source, published_date, unit, point_in_time_ready, row_valid,
       fiscal_year, CAST(NULL AS BIGINT) AS fiscal_quarter, period_end FROM cl_fin
""")
def job_financials(spark, folder):
    return clean.financials(L.Landed(Market(spark, folder)).financials(), "annual").select(
        "ticker", "statement", "report_period", "item_code", "value", "source", "published_date", "unit",
        "point_in_time_ready", "row_valid", "fiscal_year", "fiscal_quarter", "period_end")


PRICE_OUT = ["ticker", "date", "open", "high", "low", "close", "volume", "source", "row_checksum", "source_checksum",
             "ohlc_valid", "volume_valid", "analysis_ready", "estimated_trading_value"]


@query("job_prices", f"SELECT {', '.join(PRICE_OUT)} FROM cl_prices")
def job_prices(spark, folder):
    return clean.prices(L.Landed(Market(spark, folder)).prices()).select(*PRICE_OUT)


@query("job_actions", "SELECT *, true AS row_valid FROM cl_actions")
def job_actions(spark, folder):
    """Events of two providers; rows equal but for the source become one."""
    events = L.Landed(Market(spark, folder)).action_events()
    both = events.withColumn("source", F.lit("vnstock KBS")).unionByName(events.withColumn("source", F.lit("vnstock VCI")))
    return clean.actions(clean.classified_actions(both)).drop("source")


@query("job_payloads", f"""
SELECT ticker, 'series' AS kind, count(*) AS rows FROM fx_fin_wide GROUP BY ticker
UNION ALL SELECT ticker, 'candles', count(*) FROM fx_bars WHERE day(date) <> 13 GROUP BY ticker
UNION ALL SELECT ticker, 'ratios', count(*) FROM fx_snapshot GROUP BY ticker
""")
def job_payloads(spark, folder):
    """All payload kinds parsed in one job, counted per ticker."""
    parts = [("series", explode_series), ("candles", explode_ohlc_arrays), ("ratios", project_index_map)]
    out = None
    for kind, fn in parts:
        rows = fn(spark, folder).groupBy("ticker").agg(F.count("*").alias("rows")).select("ticker", F.lit(kind).alias("kind"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
