"""Price generations: reconcile, upsert, lineage, revisions and back-adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.functions import cleaning as c
from tapeframe.functions.numeric import first_match, is_true
from tapeframe.operators.ranking import first_per_key

OHLC = ("open", "high", "low", "close")
KEY = ["ticker", "date"]
# Sources whose history is already back-adjusted, and the two tolerances.
SOURCE_ADJUSTED = ("dnse", "vnstock vci", "vnstock kbs")
DISCREPANCY = 0.20
MAX_FACTOR = 1.5


def reconcile(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows, replaced where broken or far off a valid fallback, plus the fallback's extra dates.

    A replaced row keeps the primary's source checksum.
    """
    columns = [n for n in primary.columns if n not in KEY]
    p = primary.withColumn("_ok", c.ohlc_valid()).select(*KEY, F.struct(*columns, "_ok").alias("p"))
    f = fallback.withColumn("_ok", c.ohlc_valid()).select(*KEY, F.struct(*columns, "_ok").alias("f"))
    both = p.join(f, KEY, "full")
    off = is_true(F.abs(F.try_divide("p.close", "f.close") - 1) > DISCREPANCY)
    take = F.col("p").isNull() | is_true(F.col("f._ok") & (~F.col("p._ok") | off))
    picked = {n: F.when(take, F.col(f"f.{n}")).otherwise(F.col(f"p.{n}")) for n in columns}
    if "source_checksum" in columns:
        picked["source_checksum"] = F.when(F.col("p").isNull(), F.col("f.source_checksum")).otherwise(F.col("p.source_checksum"))
    return both.select(*KEY, *[v.alias(n) for n, v in picked.items()],
                       F.when(F.col("p").isNull(), "added").when(take, "replaced").otherwise("primary").alias("origin"))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newer generation replaces the older one; source rank only breaks ties inside a generation."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = first_match([(F.lower("source").startswith(p), r) for p, r in (("dnse", 0), ("vnstock kbs", 10), ("vnstock vci", 20))], 99)
    both = both.filter("ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")
    return first_per_key(both, KEY, [F.col("_new").desc(), rank.asc(), F.col("source").asc(), F.col("close").asc()]).drop("_new")


def _same(a: str, b: str) -> Column:
    return F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))


def revisions(existing: DataFrame, incoming: DataFrame, run_id: str, reason: str,
              include_removed: bool = False) -> DataFrame:
    """Old and new values of every bar whose content or source checksum changed."""
    facts = (*OHLC, "volume", "source", "row_checksum", "source_checksum")
    old = existing.select(*KEY, *[F.col(n).alias(f"old_{n}") for n in facts])
    new = incoming.select(*KEY, *[F.col(n).alias(f"new_{n}") for n in facts], F.lit(True).alias("_in"))
    return revised(old.join(new, KEY, "left" if include_removed else "inner"), run_id, reason)


def revised(both: DataFrame, run_id: str, reason: str) -> DataFrame:
    """The changed ones of bars with ``old_`` and ``new_`` values; ``_in`` is null where the bar is no longer there."""
    facts = (*OHLC, "volume", "source", "row_checksum", "source_checksum")
    changed = F.col("_in").isNull() | ~(_same("old_row_checksum", "new_row_checksum")
                                        & _same("old_source_checksum", "new_source_checksum"))
    return both.filter(changed).select(
        F.lit(run_id).alias("sync_run_id"), *KEY, F.lit(reason).alias("reason"),
        F.when(F.col("_in").isNull(), "deleted").otherwise("updated").alias("change_type"),
        *[f"old_{n}" for n in facts], *[f"new_{n}" for n in facts])


def source_restatements(rows: DataFrame) -> DataFrame:
    """Only a change from one source checksum to another proves that the source restated history."""
    return rows.filter(F.col("old_source_checksum").isNotNull() & F.col("new_source_checksum").isNotNull()
                       & (F.col("old_source_checksum") != F.col("new_source_checksum")))


def unconfirmed(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Restated bars whose new checksum a second fetch did not reproduce; must be empty to proceed."""
    return expected.join(observed, [*KEY, "new_source_checksum"], "left_anti")


def apply_lineage(incoming: DataFrame, existing: DataFrame, fetched_at: str) -> DataFrame:
    """Unchanged bars keep time and version, changed ones go one version up, new ones start at 1."""
    old = existing.select(*KEY, F.col("row_checksum").alias("_rc"), F.col("source_checksum").alias("_sc"),
                          F.col("fetched_at").alias("_at"), F.col("data_version").alias("_v"))
    return with_lineage(incoming.join(old, KEY, "left"), fetched_at).drop("_rc", "_sc", "_at", "_v")


def with_lineage(both: DataFrame, fetched_at: str) -> DataFrame:
    """Bars beside the checksums ``_rc`` and ``_sc``, time ``_at`` and version ``_v`` they had, null where they are new."""
    same = is_true((F.col("row_checksum") == F.col("_rc")) & _same("source_checksum", "_sc"))
    return both.withColumns({
        "fetched_at": F.when(same, F.col("_at")).otherwise(F.lit(fetched_at)),
        "data_version": F.when(same, F.col("_v")).otherwise(F.coalesce(F.col("_v") + 1, F.lit(1))).cast("long"),
    })


class Meeting:
    """A stored generation and a batch of bars, each with every key once, side by side after one move by the columns ``by``.

    Joins for the bars that stay, their lineage and their revisions would move the stored ones once each.  ``by`` must be
    the same for both bars of a key.  Batch bars with ``removed`` take theirs out of the table.
    """

    def __init__(self, stored: DataFrame, batch: DataFrame, by: dict[str, Column]):
        self.columns = stored.columns
        both = stored.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        both = both.withColumns(by).repartition(*by)
        key = Window.partitionBy(*by, *KEY).orderBy("_new")
        before = F.when(F.col("_new"), F.lag(F.struct(*self.columns)).over(key)).otherwise(F.struct(*self.columns))
        self.rows = both.withColumns({"_old": before, "_last": F.lead("_new").over(key).isNull()}).filter("_last").drop("_last")

    def upserted(self, fetched_at: str) -> DataFrame:
        """What ``upsert`` makes of the bars that stay and of the batch with its lineage."""
        old = {f"_{n}": F.col(f"_old.{c}") for n, c in (("rc", "row_checksum"), ("sc", "source_checksum"), ("at", "fetched_at"), ("v", "data_version"))}
        lined = with_lineage(self.rows.withColumns(old), fetched_at)
        given = F.col("_new") & ~F.col("removed") & F.col("close").isNotNull()
        stays = F.col("_old").isNotNull() & ~(F.col("_new") & F.col("removed"))
        out = lined.filter(given | stays).withColumn("_given", F.coalesce(given, F.lit(False)))
        out = out.withColumns({n: F.when(F.col("_given"), F.col(n)).otherwise(F.col(f"_old.{n}")) for n in self.columns if n not in KEY})
        return out.filter("ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")

    def revisions(self, run_id: str, reason: str) -> DataFrame:
        """Old and new values of the stored bars that the batch changed or removed."""
        facts = (*OHLC, "volume", "source", "row_checksum", "source_checksum")
        met = self.rows.filter(F.col("_new") & F.col("_old").isNotNull() & F.col("ticker").isNotNull() & F.col("date").isNotNull())
        here = F.when(~F.col("removed"), True)
        return revised(met.select(*KEY, *[F.col(f"_old.{n}").alias(f"old_{n}") for n in facts],
                                  *[F.when(here, F.col(n)).alias(f"new_{n}") for n in facts], here.alias("_in")), run_id, reason)


def backfill_lineage(rows: DataFrame, fetched_at: str) -> DataFrame:
    from tapeframe.operators.clean import with_checksums
    out = with_checksums(rows)
    return out.withColumns({"fetched_at": F.coalesce("fetched_at", F.lit(fetched_at)),
                            "data_version": F.coalesce("data_version", F.lit(1)).cast("long")})


def _factor() -> Column:
    """Price factor of one action given the last raw close before it; null where terms are missing."""
    close, kind = F.col("_before"), F.col("action_type")
    cash = c.price_unit_value(F.col("cash_dividend"), close)
    ratio, rights = c.percent_ratio(F.col("stock_ratio")), c.percent_ratio(F.col("rights_ratio"))
    price = c.price_unit_value(F.col("rights_price"), close)
    raw = (
        F.when(kind == "cash_dividend", F.when((cash > 0) & (cash < close), (close - cash) / close))
        .when(kind.isin("stock_dividend", "bonus_shares"), F.when(ratio > 0, 1.0 / (1.0 + ratio)))
        .when(kind == "stock_split", F.when(F.col("split_ratio") > 0, F.try_divide(F.lit(1.0), F.col("split_ratio"))))
        .when(kind == "rights_issue", F.when((rights > 0) & price.isNotNull(),
                                             (close + rights * price) / (close * (1.0 + rights)))))
    return F.when((close > 0) & (raw > 0) & (raw <= MAX_FACTOR), raw)


def action_line(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars and actions of a ticker on one time line, each action with its factor.

    An action comes before the bar of its own date.  Actions outside the ticker's
    bars do not count.
    """
    b = bars.withColumn("_side", F.lit(1))
    a = actions.select("ticker", F.col("ex_date").alias("date"), "action_type", "cash_dividend", "stock_ratio",
                       "split_ratio", "rights_ratio", "rights_price", F.lit(0).alias("_side"))
    line = b.unionByName(a, allowMissingColumns=True)
    is_bar = F.col("_side") == 1
    past = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ticker")
    line = line.withColumns({
        "_before": F.last(F.when(is_bar, F.struct("close")), ignorenulls=True).over(past)["close"],
        "_seen": F.count(F.when(is_bar, F.lit(1))).over(past),
        "_last": F.max(F.when(is_bar, F.col("date"))).over(whole)})
    counts = ~is_bar & (F.col("_seen") > 0) & (F.col("date") <= F.col("_last"))
    return line.withColumns({"_applies": counts, "_factor": F.when(counts, _factor())})


def adjust_prices(bars: DataFrame, actions: DataFrame, source_adjusted: Column | None = None) -> DataFrame:
    """Back-adjust every bar by the product of the factors of all later actions.

    Factors use raw closes, so they are independent of each other and the product
    is one window over the ticker's time line; no bar is paired with an action.
    """
    line = action_line(bars, actions)
    later = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("_side").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ticker")
    line = line.withColumns({
        "factor": F.coalesce(F.product(F.col("_factor")).over(later), F.lit(1.0)),
        "_actions": F.count(F.when(F.col("_side") == 0, F.lit(1))).over(whole),
        "_applied": F.count("_factor").over(whole),
        "_bad": F.count(F.when(F.col("_applies") & F.col("_factor").isNull(), F.lit(1))).over(whole)})
    status = (F.when(F.col("_actions") == 0, "NOT_REQUIRED").when(F.col("_bad") > 0, "PARTIAL")
              .when(F.col("_applied") == 0, "NOT_REQUIRED").otherwise("APPLIED"))
    out = line.filter("_side = 1").withColumn("adjustment_status", status)
    if source_adjusted is not None:
        ready = F.coalesce(source_adjusted, F.lit(False))
        out = out.withColumn("_all_ready", F.bool_and(ready).over(whole)).withColumns({
            "factor": F.when(F.col("_all_ready"), 1.0).otherwise(F.col("factor")),
            "adjustment_status": F.when(F.col("_all_ready"), "SOURCE_ADJUSTED").otherwise(F.col("adjustment_status"))})
    out = out.withColumns({f"adjusted_{n}": F.col(n) * F.col("factor") for n in OHLC if n in bars.columns})
    return out.select(*bars.columns, "factor", *[f"adjusted_{n}" for n in OHLC if n in bars.columns], "adjustment_status")


def source_is_adjusted(source: Column) -> Column:
    return F.lower(F.trim(source)).isin(*SOURCE_ADJUSTED)


def merge_financial_sources(rows: DataFrame, primary: str) -> DataFrame:
    """One row per statement cell: the primary's value, all sources in order, first publication date.

    Copies are reduced per (cell, source) before they meet, so a cell's final step
    sees one row per source however many copies there are.
    """
    keys = ["ticker", "statement", "report_period", "period_type", "item_code"]
    rank = F.when(F.lower("source").contains(primary.lower()), 0).otherwise(1)
    per_source = rows.withColumn("_rank", rank).groupBy(*keys, "source", "_rank").agg(
        F.min("published_date").alias("_pub"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"))
    cell = per_source.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "source", F.col("_lo").alias("_first"), "_pub"))).alias("_s"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("candidates"))
    chosen = F.col("_s")[0]["_first"]
    known = F.filter(F.transform("_s", lambda s: s["_first"]), lambda v: v.isNotNull())
    anchor = F.get(known, F.lit(0))
    scale = F.greatest(F.abs(anchor), F.lit(1.0))
    spread = F.greatest(F.abs(F.col("_hi") - anchor), F.abs(F.col("_lo") - anchor)) / scale
    dates = F.filter(F.transform("_s", lambda s: s["_pub"]), lambda v: v.isNotNull())
    return cell.select(*keys, chosen.alias("value"),
                       F.array_join(F.transform("_s", lambda s: s["source"]), " | ").alias("source"),
                       F.get(dates, F.lit(0)).alias("published_date"), "candidates",
                       is_true(spread > 0.02).alias("mismatch"))


def pivot_items(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Long statement rows to one column per item; best source first across statements."""
    best = first_per_key(rows.filter("row_valid"), ["ticker", "report_period", "item_code"],
                         [F.col("source_priority").asc_nulls_last(), F.col("source").asc(), F.col("value").asc()])
    return best.groupBy("ticker", "report_period", "fiscal_year", "period_end").pivot("item_code", codes).agg(F.first("value"))
