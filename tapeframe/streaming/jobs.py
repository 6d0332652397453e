"""Structured Streaming jobs over ticks, bars and events.

Sinks written from ``foreachBatch`` are idempotent per epoch: each epoch writes its
own folder in overwrite mode, so a repeated micro-batch replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tapeframe.operators import prices as px
from tapeframe.operators.ranking import first_per_key
from tapeframe.runtime import new_path, shuffles_removed
from tapeframe.sources.files import exists, read_pointer, remove, replace_pointer
from tapeframe.sources.tables import read_version


@dataclass
class Feed:
    """A folder that grows slice by slice, and the stream over it.

    One query stays up while the slices arrive; each is taken in whole before the next one comes.
    """

    stream: DataFrame
    path: str
    slices: list[DataFrame]

    def run(self, *writers: DataStreamWriter, before: Callable[[int], None] | None = None) -> None:
        """``before`` is called with a slice's number ahead of its arrival."""
        running = [writer.start() for writer in writers]
        try:
            for number, part in enumerate(self.slices):
                if before is not None:
                    before(number)
                with shuffles_removed(part.sparkSession):
                    part.write.mode("append").parquet(self.path, compression="zstd")
                for query in running:
                    query.processAllAvailable()
        finally:
            for query in running:
                query.stop()


def feed_of(slices: list[DataFrame], name: str, once: bool = False) -> Feed:
    """``once`` is for feeds of a single query: the files of a slice go when the trigger after theirs begins."""
    spark, schema = slices[0].sparkSession, slices[0].schema
    path = new_path(spark, name)
    slices[0].limit(0).write.parquet(path)
    return Feed(spark.readStream.schema(schema).option("cleanSource", "delete" if once else "off").parquet(path), path, slices)


# Rows of one slice, and so of one trigger, if they are spread evenly over time.
SLICE_ROWS = 5_000_000


def replay(rows: DataFrame, name: str, order: str, parts: int = 3, then: DataFrame | None = None) -> Feed:
    """A table cut into equal spans of time, oldest first; their number grows with the table, so that a trigger stays bounded.

    The source is read once and written by slice.  ``then`` arrives together with the last slice.
    """
    at = F.col(order).cast("double")
    low, high, count = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    parts = max(parts, -(-count // SLICE_ROWS))
    span = F.floor((at - low) / max((high or 0.0) - (low or 0.0), 1.0) * (parts - 1e-6)) if count else F.lit(0)
    path = new_path(rows.sparkSession, f"{name}-slices")
    rows.withColumn("_slice", span.cast("long")).write.partitionBy("_slice").parquet(path)
    sliced = rows.sparkSession.read.schema(with_long(rows.schema, "_slice")).parquet(path)
    slices = [sliced.filter(F.col("_slice") == i).drop("_slice") for i in range(parts)]
    if then is not None:
        slices[-1] = slices[-1].unionByName(then)
    return feed_of(slices, name)


def with_long(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, LongType())])


def updates(stream: DataFrame, keys: list[str], name: str) -> tuple[DataStreamWriter, Callable[[], DataFrame]]:
    """A writer in update mode, and a reader of the last value each key had."""
    spark = stream.sparkSession
    out, schema = new_path(spark, name), with_long(stream.schema, "epoch")
    spark.createDataFrame([], schema).write.partitionBy("epoch").parquet(out)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    def read() -> DataFrame:
        rows = spark.read.schema(schema).parquet(out)
        values = [c for c in rows.columns if c not in (*keys, "epoch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v")).select(*keys, "_v.*")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", new_path(spark, name + "-checkpoint")), read


def appends(stream: DataFrame, name: str) -> tuple[DataStreamWriter, Callable[[], DataFrame]]:
    """A writer in append mode, and a reader of what is final."""
    spark = stream.sparkSession
    out, schema = new_path(spark, name), stream.schema
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", new_path(spark, name + "-checkpoint"))
    return writer, lambda: spark.read.schema(schema).parquet(out)


def run_updates(feed: Feed, stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run in update mode and return the last value each key had."""
    writer, read = updates(stream, keys, name)
    feed.run(writer)
    return read()


def run_append(feed: Feed, stream: DataFrame, name: str) -> DataFrame:
    writer, read = appends(stream, name)
    feed.run(writer)
    return read()


def session_candles(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Candle per ticker and day, provisional until the watermark passes the day's end."""
    at = F.struct("ts", "tick_id")
    return ticks.withWatermark("ts", lateness).groupBy("ticker", F.window("ts", "1 day")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume")).select(
        "ticker", F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def closed_and_open_candles(feed: Feed, lateness: str = "1 day") -> DataFrame:
    """Every candle with ``closed``: final ones from a query in append mode, which gives a window out when the watermark
    has passed it, and the last state of the open ones from a query in update mode.

    Both drop a tick whose day the watermark had passed when it came.
    """
    final, read_final = appends(session_candles(feed.stream, lateness), "final-candles")
    latest, read_latest = updates(session_candles(feed.stream, lateness), ["ticker", "date"], "latest-candles")
    feed.run(final, latest)
    done = read_final().withColumn("closed", F.lit(True))
    open_ = read_latest().join(done.select("ticker", "date"), ["ticker", "date"], "left_anti").withColumn("closed", F.lit(False))
    return done.unionByName(open_)


def fresh_only(ticks: DataFrame, seen: str = "seen_at") -> DataFrame:
    """Ticks at most 900 s old and at most 120 s ahead when they arrive."""
    age = F.col(seen).cast("double") - F.col("ts").cast("double")
    return ticks.filter((age >= -120) & (age <= 900))


def latest_trades(ticks: DataFrame) -> DataFrame:
    at = F.struct("ts", "tick_id")
    return ticks.groupBy("ticker").agg(F.max("ts").alias("ts"), F.max_by("price", at).alias("price"), F.max_by("size", at).alias("size"))


def live_marks(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """Every quote of a held ticker with the value it gives the position."""
    return ticks.join(positions, "ticker").select("tick_id", "ticker", "account", (F.col("price") * F.col("quantity")).alias("marked_value"))


def run_live_marks(feed: Feed, root: str, table: str, name: str, before: Callable[[int], None] | None = None) -> DataFrame:
    """Quotes marked with the positions that are published when their micro-batch starts.

    An epoch notes the version it reads before it writes, and keeps to it if it is repeated.
    """
    spark, out = feed.stream.sparkSession, new_path(feed.stream.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        noted = f"{out}/_versions/{epoch}"
        version = read_pointer(spark, noted)
        if version is None:
            version = read_pointer(spark, f"{root}/_current/{table}")
            replace_pointer(spark, noted, version)
        live_marks(batch, read_version(spark, root, table, version)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    feed.run(feed.stream.writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, name + "-checkpoint")), before=before)
    return spark.read.parquet(out).drop("epoch")


QUOTA_SCHEMA = "event_id long, subject long, at_s long, allowed boolean, remaining long, retry_after long"


# Waiting events up to which a subject keeps them in one value.
FEW_EVENTS = 1_000


class Quota(StatefulProcessor):
    """Allow or deny against a window that starts at a subject's first event.

    Events wait in state and are decided in spans of time as long as the window, each when the watermark has passed its
    end.  A subject with few waiting events keeps them in one value beside its running window, with a timer for the
    first span that waits: when it fires, every span the watermark has passed is decided at once.  So such a subject
    costs a few state calls a trigger, however many spans its events fall into.

    The events of a subject with more of them wait in the chunks they came in, under their span, each span with a timer
    of its own.  A span meets at most two windows, one that is running and one that starts in it, and only the first
    ``limit`` events of a window are allowed; so the span is read chunk by chunk for the earliest events of both, and
    once more to give the decisions out.  Memory is one chunk, whatever a subject sends.

    A last timer ends a window, so a subject that falls silent leaves no state.  Events behind the watermark are
    dropped before they come here.
    """

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "started long, used long, spans long, times array<long>, ids array<long>")
        self.sizes = handle.getMapState("sizes", "span long", "chunks long")
        self.chunks = handle.getMapState("chunks", "span long, number long", "times array<long>, ids array<long>")

    def held(self) -> tuple[int | None, int, int, np.ndarray, np.ndarray]:
        """The running window, the number of spans that wait in chunks, and the few events that wait beside it."""
        started, used, spans, times, ids = self.running.get() or (None, 0, 0, [], [])
        return started, used, spans, np.array(times, dtype=np.int64), np.array(ids, dtype=np.int64)

    def hold(self, started: int | None, used: int, spans: int, times: np.ndarray, ids: np.ndarray) -> None:
        self.running.update((started, used, spans, times.tolist(), ids.tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, used, spans, times, ids = self.held()
        for batch in rows:
            times, ids = np.append(times, batch["at_s"].to_numpy(np.int64)), np.append(ids, batch["event_id"].to_numpy(np.int64))
            if spans or len(times) > FEW_EVENTS:
                spans += self.file(times, ids)
                times, ids = times[:0], ids[:0]
        if len(times):
            self.wake(times)
        self.hold(started, used, spans, times, ids)
        return iter([])

    def wake(self, times: np.ndarray) -> None:
        self.handle.registerTimer((int(times.min()) // self.window + 1) * self.window * 1000)

    def file(self, times: np.ndarray, ids: np.ndarray) -> int:
        """Put events into chunks of their spans; returns how many spans had none before."""
        fresh, spans = 0, times // self.window
        for span in np.unique(spans).tolist():
            own = spans == span
            known = self.sizes.getValue((span,)) if self.sizes.containsKey((span,)) else None
            number = known[0] if known else 0
            if not number:
                self.handle.registerTimer((span + 1) * self.window * 1000)
                fresh += 1
            self.chunks.updateValue((span, number), (times[own].tolist(), ids[own].tolist()))
            self.sizes.updateValue((span,), (number + 1,))
        return fresh

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, now = expiredTimerInfo.getExpiryTimeInMs() // 1000, timerValues.getCurrentWatermarkInMs() // 1000
        started, used, spans, times, ids = self.held()
        if spans:
            if end % self.window == 0 and self.sizes.containsKey((end // self.window - 1,)):
                yield from self.decided(key, end // self.window - 1, now)
        elif len(times):
            due = times < now // self.window * self.window
            if due.any():
                started, used, out = self.walked(key, started, used, times[due], ids[due])
                self.settle(started, used, times[~due], ids[~due], now)
                yield out
        elif started is not None and started + self.window <= end:
            self.running.clear()

    def walked(self, key, started: int | None, used: int, times: np.ndarray, ids: np.ndarray) -> tuple[int, int, pd.DataFrame]:
        """Decisions of events that wait in one value, window after window; equal events are decided alike."""
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        ranks, starts, at = np.full(len(times), -1), np.empty(len(times), dtype=np.int64), 0
        while at < len(times):
            if started is None or times[at] >= started + self.window:
                started, used = int(times[at]), 0
            end = at + int(np.searchsorted(times[at:], started + self.window))
            starts[at:end] = started
            kept = list(zip(times[at:at + self.limit - used].tolist(), ids[at:at + self.limit - used].tolist()))[:end - at]
            rank = {event: used + i for i, event in enumerate(kept)}
            for i in range(at, end):
                ranks[i] = rank.get((times[i], ids[i]), -1)
                if i - at >= len(kept) and ranks[i] < 0:
                    break
            used, at = used + len(kept), end
        return started, used, self.frame(key, times, ids, ranks, starts)

    def settle(self, started: int, used: int, times: np.ndarray, ids: np.ndarray, now: int) -> None:
        """Keep the window that runs and the events that still wait, or nothing if neither is there."""
        if len(times):
            self.wake(times)
        elif started + self.window <= now:
            return self.running.clear()
        else:
            self.handle.registerTimer((started + self.window) * 1000)
        self.hold(started, used, 0, times, ids)

    def frame(self, key, times: np.ndarray, ids: np.ndarray, ranks: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        allowed = ranks >= 0
        return pd.DataFrame({"event_id": ids, "subject": key[0], "at_s": times, "allowed": allowed, "remaining": np.where(allowed, self.limit - 1 - ranks, 0),
                             "retry_after": np.where(allowed, 0, np.maximum(1, self.window - (times - starts)))})

    def read(self, span: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        times, ids = self.chunks.getValue((span, number))
        return np.array(times, dtype=np.int64), np.array(ids, dtype=np.int64)

    def decided(self, key, span: int, now: int) -> Iterator[pd.DataFrame]:
        count = self.sizes.getValue((span,))[0]
        started, used, spans, none, _ = self.held()
        border = -(1 << 62) if started is None else started + self.window
        old: list[tuple[int, int]] = []
        new: list[tuple[int, int]] = []
        for number in range(count):
            times, ids = self.read(span, number)
            old = earliest(old, times, ids, times < border, self.limit - used)
            new = earliest(new, times, ids, times >= border, self.limit)
        rank = {event: used + i for i, event in enumerate(old)} | {event: i for i, event in enumerate(new)}
        begin = new[0][0] if new else None
        for number in range(count):
            times, ids = self.read(span, number)
            self.chunks.removeKey((span, number))
            ranks = np.array([rank.get(event, -1) for event in zip(times.tolist(), ids.tolist())], dtype=np.int64)
            yield self.frame(key, times, ids, ranks, np.where(times >= border, 0 if begin is None else begin, 0 if started is None else started))
        self.sizes.removeKey((span,))
        started, used = (started, used + len(old)) if begin is None else (begin, len(new))
        if spans == 1:
            self.settle(started, used, none, none, now)
        else:
            self.hold(started, used, spans - 1, none, none)

    def close(self) -> None:
        pass


def earliest(kept: list[tuple[int, int]], times: np.ndarray, ids: np.ndarray, own: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n smallest (time, id) of those kept and a chunk's own ones."""
    if n <= 0 or not own.any():
        return kept[:max(n, 0)]
    times, ids = times[own], ids[own]
    first = np.lexsort((ids, times))[:n]
    return sorted(kept + list(zip(times[first].tolist(), ids[first].tolist())))[:n]


def quota_stream(events: DataFrame, limit: int, window: int, lateness: str = "1 second") -> DataFrame:
    """events (event_id, subject, at_s) -> plus allowed, remaining, retry_after, once the watermark has passed their span.

    Rows without a subject or a time are no events; they only move the watermark.
    """
    timed = events.withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", lateness)
    timed = timed.where(F.when(F.col("at").isNotNull(), F.col("subject")).isNotNull())  # after the watermark has seen the row
    return timed.groupBy("subject").transformWithStateInPandas(Quota(limit, window), QUOTA_SCHEMA, "Append", "EventTime")


def run_quota(feed: Feed, limit: int, window: int) -> DataFrame:
    """All decisions of a feed.  A clock row of no subject follows the last slice and moves the watermark past every span."""
    clock = feed.slices[0].agg(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("subject"), F.lit(END_OF_TIME).alias("at_s"))
    timed = Feed(feed.stream, feed.path, [*feed.slices, clock])
    with keyed_state(feed.stream.sparkSession):
        return run_append(timed, quota_stream(feed.stream, limit, window), "quota")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Several named states per key need a state store that knows column families; a query takes the setting when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


END_OF_TIME = 32_503_680_000  # the year 3000


class LineageTable:
    """Bars by month.  An epoch writes the months it touches in full and then replaces one pointer file, which names the
    epoch that holds each month; readers open exactly these folders, all of one version.

    The version before stays readable until the next switch, for readers that have started and for an epoch that is
    repeated after a failure: it starts from the version before it and replaces what it wrote.  Folders that neither
    version names are removed, so the number of files is bounded by the number of months.  A batch may have a column
    ``removed``: such bars leave the table, and the log says so.  The log's parts are folded into one from time to time.
    """

    LOG_PARTS = 8
    FILE_ROWS = 100_000  # about, of a file of a month

    def __init__(self, spark: SparkSession, root: str, columns: StructType):
        self.spark, self.root = spark, root
        self.schema = StructType([f for f in columns.fields if f.name != "removed"])
        self.log_schema = px.revisions(self.empty(), self.empty(), "", "", include_removed=True).schema

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def state(self) -> dict:
        found = read_pointer(self.spark, f"{self.root}/current")
        return json.loads(found) if found else {"epoch": -1, "months": {}, "log": [], "before": None}

    def opened(self, version: dict, months: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/table/epoch={e}/month={m}" for m, e in version["months"].items() if months is None or m in months]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty()

    def rows(self) -> DataFrame:
        return self.opened(self.state())

    def revisions(self) -> DataFrame:
        parts = [f"{self.root}/revisions/{part}" for part in self.state()["log"]]
        return self.spark.read.schema(self.log_schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.log_schema)

    def merge(self, batch: DataFrame, epoch: int, fetched_at: str) -> None:
        now = self.state()
        base = now if now["epoch"] < epoch else now["before"]
        marked = batch if "removed" in batch.columns else batch.withColumn("removed", F.lit(False))
        marked = marked.withColumn("removed", F.coalesce("removed", F.lit(False)))
        with shuffles_removed(marked.sparkSession):
            keys = marked.groupBy(*px.KEY).agg(F.count("*").alias("n")).groupBy(month_of("date").alias("month")).agg(F.count("*").alias("n"), F.max("n").alias("copies"))
            touched = {str(r.month): r for r in keys.collect()}  # at most the months of the calendar
        if any(r.copies > 1 for r in touched.values()):
            order = [F.col("removed").asc(), *[F.col(c).desc_nulls_last() for c in marked.columns if c not in (*px.KEY, "removed")]]
            marked = first_per_key(marked, px.KEY, order)
        known = self.opened(base, list(touched))
        met = px.Meeting(known, marked, self.placed(known, touched))
        path = f"{self.root}/table/epoch={epoch}"
        self.write(met.upserted(fetched_at).select(*self.schema.fieldNames(), "month"), path, "month")
        changed = met.revisions(f"epoch-{epoch}", "stream") if set(base["months"]) & set(touched) else self.spark.createDataFrame([], self.log_schema)
        self.write(changed, f"{self.root}/revisions/{epoch}")
        months = {m: e for m, e in base["months"].items() if m not in touched} | {m: epoch for m in touched if exists(self.spark, f"{path}/month={m}")}
        log = self.folded([*base["log"], str(epoch)], epoch)
        before = {"epoch": base["epoch"], "months": base["months"], "log": base["log"]}
        replace_pointer(self.spark, f"{self.root}/current", json.dumps({"epoch": epoch, "months": months, "log": log, "before": before}))
        self.vacuum(base.get("before"), months, log, before)
        if str(epoch) not in log:  # it is in the folded part
            remove(self.spark, f"{self.root}/revisions/{epoch}")

    def placed(self, known: DataFrame, touched: dict[str, Row]) -> dict[str, Column]:
        """Where a bar goes: to its month, and in it to one of as many places as the largest month has files."""
        with shuffles_removed(known.sparkSession):
            held = {str(r.month): r.n for r in known.groupBy(month_of("date").alias("month")).agg(F.count("*").alias("n")).collect()}
        most = max((held.get(m, 0) + r.n for m, r in touched.items()), default=0)
        return {"month": month_of("date"), "_place": F.pmod(F.hash("ticker"), F.lit(most // self.FILE_ROWS + 1))}

    def write(self, rows: DataFrame, path: str, *by: str) -> None:
        with shuffles_removed(rows.sparkSession):
            rows.write.mode("overwrite").partitionBy(*by).parquet(path, compression="zstd")

    def folded(self, parts: list[str], epoch: int) -> list[str]:
        if len(parts) < self.LOG_PARTS:
            return parts
        whole = self.spark.read.schema(self.log_schema).parquet(*[f"{self.root}/revisions/{p}" for p in parts])
        self.write(whole.hint("rebalance"), f"{self.root}/revisions/upto-{epoch}")
        return [f"upto-{epoch}"]

    def vacuum(self, oldest: dict | None, months: dict, log: list[str], before: dict) -> None:
        """Remove what only the version before the last one named."""
        if not oldest:
            return
        held = set(months.items()) | set(before["months"].items())
        for month, epoch in set(oldest["months"].items()) - held:
            remove(self.spark, f"{self.root}/table/epoch={epoch}/month={month}")
        for epoch in set(oldest["months"].values()) - {e for _, e in held}:
            remove(self.spark, f"{self.root}/table/epoch={epoch}")
        for part in set(oldest["log"]) - set(log) - set(before["log"]):
            remove(self.spark, f"{self.root}/revisions/{part}")


def month_of(date: str) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("long")


def upsert_lineage(feed: Feed, fetched_at: str, name: str, root: str | None = None) -> LineageTable:
    """Merge micro-batches of bars into a table by month and log what they revised; the same root goes on where it was."""
    spark = feed.stream.sparkSession
    root = root or new_path(spark, name)
    none = spark.createDataFrame([], feed.stream.schema).withColumns({"fetched_at": F.lit(fetched_at), "data_version": F.lit(1).cast("long")})
    table = LineageTable(spark, root, none.schema)
    feed.run(feed.stream.writeStream.foreachBatch(lambda batch, epoch: table.merge(batch, epoch, fetched_at)).option(
        "checkpointLocation", f"{root}/checkpoint"))
    return table
