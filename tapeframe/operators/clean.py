"""The cleaning jobs: landed tables in, typed and keyed tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.functions import cleaning as c
from tapeframe.functions.numeric import is_true
from tapeframe.operators.ranking import first_per_key

OHLC = ("open", "high", "low", "close")


def clean_text(frame: DataFrame) -> DataFrame:
    """Repair and blank-to-null every text column in one projection."""
    texts = [f.name for f in frame.schema if f.dataType.simpleString() == "string"]
    return frame.withColumns({n: c.blank_to_null(c.repair_mojibake(F.col(n))) for n in texts})


def companies(landed: DataFrame) -> DataFrame:
    out = clean_text(landed).withColumns({
        "ticker": c.normalize_ticker(F.col("ticker")),
        "listing_date": c.date_prefix(F.col("listing_date")),
        "market_cap": c.coerce_numeric(F.col("market_cap")),
    })
    return first_per_key(out, ["ticker"], [F.col("landed_at").desc()])


def financials(landed: DataFrame, period_type: str) -> DataFrame:
    """Typed statement rows, one per key, best source first."""
    out = clean_text(landed)
    period = F.regexp_replace(F.trim(F.col("report_period")), r"\.0$", "")
    out = out.withColumns({
        "ticker": c.normalize_ticker(F.col("ticker")), "statement": F.lower(F.trim("statement")),
        "period_type": F.lower(F.trim("period_type")), "item_code": F.lower(F.trim("item_code")),
        "report_period": period, "source_priority": c.source_priority(F.col("source"))})
    out = first_per_key(out, ["ticker", "statement", "report_period", "item_code"],
                        [F.col("source_priority").asc_nulls_last(), F.col("source").asc_nulls_last(),
                         F.col("value").asc_nulls_last()])
    return out.withColumns({
        "unit": c.financial_unit(F.col("item_code")),
        "point_in_time_ready": F.col("published_date").isNotNull(),
        "row_valid": F.col("ticker").isNotNull() & F.col("report_period").isNotNull() & F.col("item_code").isNotNull()
        & F.col("value").isNotNull() & is_true(F.col("period_type") == period_type),
        "fiscal_year": c.fiscal_year(F.col("report_period")),
        "fiscal_quarter": c.fiscal_quarter(F.col("report_period")),
        "period_end": c.period_end(F.col("report_period"))})


def typed_prices(landed: DataFrame) -> DataFrame:
    out = clean_text(landed)
    return out.withColumns({"ticker": c.normalize_ticker(F.col("ticker")), "date": c.date_prefix(F.col("date")),
                            "source_priority": c.source_priority(F.col("source"))})


def best_price_rows(typed: DataFrame) -> DataFrame:
    return first_per_key(typed, ["ticker", "date"],
                         [F.col("source_priority").asc_nulls_last(), F.col("source").asc_nulls_last(),
                          F.col("close").asc_nulls_last(), F.col("volume").asc_nulls_last()])


def with_checksums(frame: DataFrame) -> DataFrame:
    """Row checksum where it is missing; the exchange's own rows carry it as their source checksum too."""
    fresh = c.row_checksum(F.col("ticker"), F.col("date"), [F.col(n) for n in (*OHLC, "volume")])
    old = c.blank_to_null(F.col("row_checksum")) if "row_checksum" in frame.columns else F.lit(None).cast("string")
    old_source = c.blank_to_null(F.col("source_checksum")) if "source_checksum" in frame.columns else \
        F.lit(None).cast("string")
    out = frame.withColumn("row_checksum", F.coalesce(old, fresh))
    return out.withColumn("source_checksum", F.coalesce(
        old_source, F.when(F.col("source") == "DNSE", F.col("row_checksum"))))


def prices(landed: DataFrame) -> DataFrame:
    """One typed row per ticker and date with validity flags, checksums and units."""
    return checked_prices(best_price_rows(typed_prices(landed)))


def checked_prices(best: DataFrame) -> DataFrame:
    """Checksums, flags and units of chosen rows; each row by itself."""
    out = with_checksums(best)
    out = out.withColumns({"ohlc_valid": c.ohlc_valid(), "volume_valid": c.volume_valid()})
    return out.withColumns({
        "analysis_ready": F.col("ticker").isNotNull() & F.col("date").isNotNull() & F.col("ohlc_valid")
        & F.col("volume_valid"),
        "estimated_trading_value": F.col("close") * F.col("volume"),
        "price_unit": F.lit("VND/share"), "volume_unit": F.lit("shares"), "trading_value_unit": F.lit("VND")})


def classified_actions(events: DataFrame) -> DataFrame:
    """Provider events to typed actions; events of no known kind are left out."""
    text = c.ascii_fold(F.col("event_title"))
    kind = c.action_type(F.col("event_code"), text)
    fields = c.action_fields(kind, F.col("exercise_ratio"), F.col("value_per_share"), text)
    return events.select("ticker", c.date_prefix(F.col("exright_date")).alias("ex_date"), kind.alias("action_type"),
                         *[v.alias(k) for k, v in fields.items()],
                         *(["source"] if "source" in events.columns else [])).filter("action_type IS NOT NULL")


def actions(rows: DataFrame) -> DataFrame:
    """Rows equal in everything but the source become one."""
    keys = [n for n in rows.columns if n != "source"]
    out = first_per_key(rows, keys, [F.col("source").asc_nulls_last()])
    return out.withColumn("row_valid", F.col("ticker").isNotNull() & F.col("ex_date").isNotNull()
                          & F.col("action_type").isNotNull())


def series_payload(payloads: DataFrame) -> DataFrame:
    """``{x: labels, type, data: [{type, y}]}`` to one (label, total) row per label.

    A "markupline" chart counts only its first line; a label without any number has no row.
    """
    shape = "x array<string>, type string, data array<struct<type:string,y:array<double>>>"
    parsed = payloads.withColumn("_p", F.from_json("payload", shape))
    lines = F.filter("_p.data", lambda s: s["type"] == "line")
    chosen = F.when(F.lower("_p.type").contains("markupline"), F.slice(lines, 1, 1)).otherwise(F.col("_p.data"))
    labels = parsed.select("*", F.posexplode("_p.x").alias("_pos", "label")).withColumn("_series", chosen)
    numbers = F.filter(F.transform("_series", lambda s: F.get(s["y"], F.col("_pos"))), lambda v: v.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v)
    return labels.withColumns({"_n": F.size(numbers), "value": total}).filter("_n > 0").drop("_p", "_series", "_pos", "_n")


def ohlc_payload(payloads: DataFrame) -> DataFrame:
    """``{t, o, h, l, c, v}`` parallel arrays to valid candles in full currency units."""
    shape = "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"
    rows = payloads.withColumn("_p", F.from_json("payload", shape)).select(
        *payloads.columns, F.explode(F.arrays_zip("_p.t", "_p.o", "_p.h", "_p.l", "_p.c", "_p.v")).alias("_r"))
    rows = rows.select(*payloads.columns, F.to_date(F.timestamp_seconds("_r.t")).alias("date"),
                       F.col("_r.o").alias("open"), F.col("_r.h").alias("high"), F.col("_r.l").alias("low"),
                       F.col("_r.c").alias("close"), F.col("_r.v").alias("volume"))
    return candles_in_units(rows).drop("payload")


def candles_in_units(rows: DataFrame) -> DataFrame:
    positive = F.least(*OHLC) > 0
    valid = c.ohlc_valid() & positive & F.col("volume").isNotNull() & (F.col("volume") >= 0)
    scale = F.when(F.col("close") < 1000, 1000.0).otherwise(1.0)
    return rows.filter(is_true(valid)).withColumn("_k", scale).withColumns(
        {n: F.round(F.col(n) * F.col("_k"), 2) for n in OHLC}).drop("_k")


def ratio_payload(payloads: DataFrame) -> DataFrame:
    """Nested ratio payload to one named column per known ratio."""
    parsed = payloads.withColumns({
        "_i": F.from_json(F.get_json_object("payload", "$.indexes"), "map<string,string>"),
        "company_type": F.get_json_object("payload", "$.companyType")})
    columns = [c.parse_percent(F.try_element_at("_i", F.lit(k))).alias(v) for k, v in c.RATIO_FIELDS.items()]
    return parsed.select("ticker", "company_type", *columns)


def unit_rescaled(bars: DataFrame, medians: DataFrame) -> DataFrame:
    """Tickers quoted in thousands (median close under 1000) are brought to full units."""
    small = F.coalesce(F.col("_median") < 1000, F.lit(False))
    joined = bars.join(medians.withColumnRenamed("median", "_median"), "ticker", "left")
    return joined.withColumns({n: F.when(small, F.round(F.col(n) * 1000.0, 4)).otherwise(F.col(n)) for n in OHLC}
                              ).drop("_median")


def session_shape(rows: DataFrame) -> DataFrame:
    """Implied previous close, range and where in the range the session closed."""
    previous = F.try_divide(F.col("close"), 1 + F.col("return_1d"))
    location = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    return rows.withColumns({
        "previous_close": previous, "range_share": F.try_divide(F.col("high") - F.col("low"), previous),
        "close_location": location,
        "close_label": F.when(location >= .8, "near_high").when(location <= .2, "near_low").otherwise("middle")})


def display_valuation(rows: DataFrame) -> DataFrame:
    """P/E for display: the provider's where positive, else last close over trailing earnings per share."""
    direct = F.when(F.col("pe") > 0, F.col("pe"))
    derived = F.when(F.col("eps_ttm") > 0, F.try_divide("close", "eps_ttm"))
    return rows.withColumns({
        "pe_ttm": F.coalesce(direct, derived),
        "pe_source": F.when(direct.isNotNull(), "provider_pe").when(
            derived.isNotNull(), "latest_eod_close_divided_by_eps_ttm").otherwise("unavailable")})


def action_fingerprints(rows: DataFrame) -> DataFrame:
    """One digest per ticker that changes exactly when the multiset of its action rows changes.

    Row hashes are added up as numbers, so the digest needs no ordering and no
    gathering of a ticker's rows.
    """
    content = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in rows.columns])
    part = F.conv(F.substring(F.sha2(content, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.withColumn("_h", part).groupBy("ticker").agg(
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("_h").cast("string")), 256).alias("fingerprint"))
