"""Upserts over many epochs and restarts, quotas with timers, and candles that are closed or open."""

import datetime as dt
import os
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeframe.operators import prices as px
from tapeframe.runtime import new_path
from tapeframe.sources import tables as tb
from tapeframe.streaming import jobs

BAR = "ticker string, date date, open double, high double, low double, close double, volume double, source string, row_checksum string, source_checksum string"


def bar(ticker, day, close, source="DNSE"):
    return ticker, day, close, close, close, close, 1.0, source, f"{ticker}{day}{close}", None


def feed_into(spark, folder, *slices):
    return jobs.Feed(spark.readStream.schema(BAR).parquet(folder), folder, list(slices))


def held(table):
    return {(r.ticker, r.close) for r in table.rows().collect()}


def test_upsert_goes_on_after_a_restart(spark):
    root, folder = new_path(spark, "lineage"), new_path(spark, "bars")
    first, second = dt.date(2024, 1, 5), dt.date(2024, 3, 5)
    frame = lambda rows: spark.createDataFrame(rows, BAR)
    frame([]).write.parquet(folder)
    jobs.upsert_lineage(feed_into(spark, folder, frame([bar("A", first, 10.0), bar("A", first, 11.0), bar("B", second, 5.0)])), "t1", "x", root)
    again = jobs.upsert_lineage(feed_into(spark, folder, frame([bar("B", second, 6.0)])), "t2", "x", root)
    want = {("A", 11.0), ("B", 6.0)}
    assert held(again) == want
    assert held(jobs.upsert_lineage(feed_into(spark, folder), "t3", "x", root)) == want
    months = again.state()["months"]
    assert set(months) == {str(2024 * 12 + 1), str(2024 * 12 + 3)} and months[str(2024 * 12 + 1)] < months[str(2024 * 12 + 3)]


def test_many_epochs_leave_a_bounded_number_of_files(spark):
    root = new_path(spark, "lineage")
    schema = spark.createDataFrame([], BAR).withColumns({"fetched_at": F.lit(""), "data_version": F.lit(1).cast("long"), "removed": F.lit(True)}).schema
    table = jobs.LineageTable(spark, root, schema)
    days = [dt.date(2024, 1 + i % 3, 1 + i % 5) for i in range(50)]
    want = {}
    sizes = []
    for epoch, day in enumerate(days):
        rows = [(*bar("A", day, float(epoch)), False), (*bar("B", day, 1.0), epoch % 2 == 1)]
        table.merge(spark.createDataFrame(rows, BAR + ", removed boolean"), epoch, f"t{epoch}")
        want[("A", day)] = float(epoch)
        want[("B", day)] = 1.0
        if epoch % 2 == 1:
            del want[("B", day)]
        if epoch == 20:
            reader = table.rows()  # opened before the next switch, read after it
            then = dict(want)
        if epoch == 21:
            assert {(r.ticker, r.date): r.close for r in reader.collect()} == then
        if epoch % 10 == 9:
            assert {(r.ticker, r.date): r.close for r in table.rows().collect()} == want
            sizes.append(sum(len(files) for _, _, files in os.walk(root.removeprefix("file:"))))
    assert max(sizes) <= 60, sizes
    table.merge(spark.createDataFrame([(*bar("A", days[-1], -1.0), False)], BAR + ", removed boolean"), 49, "again")  # the last epoch is repeated
    want[("A", days[-1])] = -1.0
    got = {(r.ticker, r.date): r.close for r in table.rows().collect()}
    assert got[("A", days[-1])] == -1.0
    log = table.revisions()
    assert log.where("change_type = 'deleted'").count() > 0 and log.select("sync_run_id").distinct().count() > 10


def test_bars_that_meet_once_become_what_joins_make_of_them(spark):
    rng, day = random.Random(3), lambda n: dt.date(2024, 1 + n % 3, 1 + n % 7)
    sums = lambda: rng.choice([None, "a", "b"])
    stored = spark.createDataFrame([(f"S{n}", day(n), 1.0, 2.0, 0.5, 1.5, 9.0, rng.choice(["DNSE", "x", None]), sums(), sums(), rng.choice(["t0", None]), rng.choice([1, 4, None]))
                                    for n in range(300)], BAR + ", fetched_at string, data_version long")
    batch = spark.createDataFrame([(f"S{n}" if n % 50 else None, day(n) if n % 41 else None, 1.0, 2.0, 0.5, rng.choice([1.5, 7.0, None]), 9.0, "DNSE", sums(), sums(), rng.random() < 0.3)
                                   for n in range(150, 450)], BAR + ", removed boolean").dropDuplicates(px.KEY)
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    met = px.Meeting(stored, batch, {"month": jobs.month_of("date"), "_place": F.pmod(F.hash("ticker"), F.lit(2))})
    gone, given = batch.filter("removed").select(*px.KEY), batch.filter("NOT removed").drop("removed")
    table = px.upsert(stored.join(gone, px.KEY, "left_anti"), px.apply_lineage(given, stored, "t1"))
    log = px.revisions(stored, given, "r", "w").unionByName(px.revisions(stored.join(gone, px.KEY, "left_semi"), stored.limit(0), "r", "w", include_removed=True))
    plain = lambda frame, columns: sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)
    assert plain(met.upserted("t1"), stored.columns) == plain(table, stored.columns) != []
    assert plain(met.revisions("r", "w"), log.columns) == plain(log, log.columns)
    assert {r.change_type for r in log.collect()} == {"updated", "deleted"}
    assert met.upserted("t1")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_an_upsert_keeps_neither_shuffles_nor_slices_it_took_in(spark):
    def shuffled():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    def gone_after(left):
        until = time.time() + 20
        while left() and time.time() < until:
            time.sleep(0.2)
        return not left()

    frame = lambda n: spark.createDataFrame([bar(f"S{i}", dt.date(2024, 1 + i % 3, 5), float(n)) for i in range(60)], BAR)
    before = shuffled()
    feed = jobs.feed_of([frame(1), frame(2)], "bar_feed", once=True)
    table = jobs.upsert_lineage(feed, "t1", "x")
    assert gone_after(lambda: shuffled() - before)
    assert table.rows().filter("close = 2 AND data_version = 2").count() == table.revisions().count() == 60
    parts = lambda: len({r.close for r in spark.read.schema(BAR).parquet(feed.path).collect()})
    assert parts() == 1


def decisions(events, limit, window):
    state, out = {}, {}
    for subject, at, event in sorted(events):
        started, used = state.get(subject, (0, 0))
        if used == 0 or at - started >= window:
            started, used = at, 0
        allowed = used < limit
        state[subject] = (started, used + allowed)
        out[event] = (allowed, limit - used - 1 if allowed else 0, 0 if allowed else max(1, window - (at - started)))
    return out


def test_quota_equals_the_walk(spark):
    rows = spark.range(6000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7 + 2).alias("subject"),
                                    (1_000_000 + F.pmod(F.col("id") * 7919, F.lit(5000))).alias("at_s"))
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in jobs.run_quota(jobs.replay(rows, "hot", "at_s"), 5, 60).collect()}
    assert got == decisions([(r.subject, r.at_s, r.event_id) for r in rows.collect()], 5, 60)


def test_quota_decides_in_time_order_across_triggers_and_forgets(spark):
    schema = "event_id long, subject long, at_s long"
    slices = [spark.createDataFrame(rows, schema) for rows in (
        [(1, 7, 130), (2, 7, 100), (3, 8, 100)], [(4, 7, 105), (5, 7, 110), (6, 8, 170)], [(7, 9, 1000)], [(8, 9, 5000)], [(9, None, 90_000)])]
    folder = new_path(spark, "quota-in")
    slices[0].limit(0).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    writer, read = jobs.appends(jobs.quota_stream(stream, 2, 60, "60 seconds"), "quota")
    query = writer.start()
    try:
        for part in slices:
            part.write.mode("append").parquet(folder)
            query.processAllAvailable()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in read().collect()}
    assert got == decisions([(r.subject, r.at_s, r.event_id) for part in slices for r in part.collect() if r.subject is not None], 2, 60)
    assert left == 0


def test_a_million_events_of_a_subject_stay_in_chunks():
    """Memory of the processor is a chunk: its state is outside, here a dictionary."""
    class State(dict):
        getValue, containsKey, removeKey = dict.get, dict.__contains__, dict.pop

        def updateValue(self, key, value):
            self[key] = value

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Timer:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    quota = jobs.Quota(5, 86_400)
    quota.handle, quota.running, quota.sizes, quota.chunks = Handle(), Value(), State(), State()
    rng = np.random.default_rng(1)
    batches = (pd.DataFrame({"event_id": np.arange(i, i + 10_000), "at_s": rng.integers(0, 80_000, 10_000)}) for i in range(0, 1_000_000, 10_000))
    list(quota.handleInputRows((1,), batches, None))
    tracemalloc.start()
    rows = allowed = 0
    for at in sorted(set(Handle.timers)):
        for out in quota.handleExpiredTimer((1,), Timer(at), Timer(at)):
            rows, allowed = rows + len(out), allowed + int(out["allowed"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for at in Handle.timers:
        list(quota.handleExpiredTimer((1,), Timer(at), Timer(at)))
    assert (rows, allowed) == (1_000_000, 5) and peak < 8_000_000
    assert not quota.sizes and not quota.chunks and not quota.running.exists()


def test_late_tick_leaves_closed_candles_alone(spark):
    schema = "ticker string, ts timestamp, price double, size long, tick_id long"
    tick = lambda day, price, n: ("A", dt.datetime(2024, 1, day, 12), price, 1, n)
    slices = [spark.createDataFrame(rows, schema) for rows in ([tick(1, 10.0, 1), tick(1, 12.0, 2)], [tick(4, 20.0, 3)], [tick(1, 99.0, 4), tick(5, 30.0, 5), tick(4, 21.0, 6)])]
    got = {r.date.day: (r.high, r.close, r.volume, r.closed) for r in jobs.closed_and_open_candles(jobs.feed_of(slices, "ticks")).collect()}
    assert got == {1: (12.0, 12.0, 2, True), 4: (21.0, 21.0, 2, False), 5: (30.0, 30.0, 1, False)}


def test_changed_positions_mark_later_quotes(spark):
    root = new_path(spark, "positions")
    held = lambda n: tb.publish(spark.createDataFrame([("A", 1, n)], "ticker string, account long, quantity long"), root, "positions", str(n))
    quote = lambda n: spark.createDataFrame([(n, "A", 10.0), (n + 100, "Z", 1.0)], "tick_id long, ticker string, price double")
    held(1)
    feed = jobs.feed_of([quote(1), quote(2), quote(3)], "quotes")
    got = jobs.run_live_marks(feed, root, "positions", "marks", before=lambda number: held(7) if number == 1 else None)
    assert {(r.tick_id, r.marked_value) for r in got.collect()} == {(1, 10.0), (2, 70.0), (3, 70.0)}


def test_a_subject_with_few_events_costs_few_state_calls():
    """Spread over a hundred windows, events of a subject wait in one value: a trigger costs a handful of calls, not some per window."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def registerTimer(self, at):
            calls.append(at)

    class Timer:
        def __init__(self, at, now):
            self.getExpiryTimeInMs, self.getCurrentWatermarkInMs = lambda: at * 1000, lambda: now * 1000

    quota = jobs.Quota(2, 60)
    quota.handle, quota.running, quota.sizes, quota.chunks = Handle(), Value(), None, None
    rng = np.random.default_rng(1)
    times, ids = rng.integers(1_000, 7_000, 400), np.arange(400)
    got = []
    for part in (times < 4_000, times >= 4_000):
        list(quota.handleInputRows((7,), iter([pd.DataFrame({"event_id": ids[part], "at_s": times[part]})]), None))
        now = 3_990 if part[times < 4_000].all() else 10_000
        first = min(at for at in calls if isinstance(at, int)) // 1000
        got += [out for out in quota.handleExpiredTimer((7,), Timer(first, now), Timer(first, now))]
    rows = pd.concat(got)
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in rows.itertuples()} == decisions(zip([7] * 400, times.tolist(), ids.tolist()), 2, 60)
    assert len(got) == 2 and len(calls) < 20 and quota.running.held is None
