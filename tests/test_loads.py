"""Two-phase loads, whole partitions, replaced pointers and the layout for lookups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeframe.plans import load_all
from tapeframe.plans.registry import QUERIES
from tapeframe.runtime import new_path
from tapeframe.sources import loads as ld
from tapeframe.sources.files import read_pointer, replace_pointer
from tapeframe.sources.layout import Clustered, publish_clustered

load_all()


def bundles(spark, n=60):
    rows = spark.range(n).select((F.col("id") % 3).alias("bundle"), "id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    return {"facts": rows, "notes": rows.where("id % 5 = 0").withColumnRenamed("v", "note")}


def states(checked):
    return {(r.bundle, r.tbl): (r.rows, r.matches, r.state) for r in checked.collect()}


def readable(target, tables):
    return {name: {r.bundle for r in target.read(name, rows.schema).select("bundle").distinct().collect()} for name, rows in tables.items()}


def test_a_run_that_ends_between_the_phases(spark, monkeypatch):
    tables = bundles(spark)
    wanted = ld.manifest(tables)
    target = ld.Target(spark, new_path(spark, "target"))
    with monkeypatch.context() as broken:
        broken.setattr(ld.Target, "commit", lambda self, checked: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            target.load(tables, wanted)
    assert readable(target, tables) == {"facts": set(), "notes": set()}
    written = []
    monkeypatch.setattr(ld, "replace_partitions", lambda rows, path, keys, real=ld.replace_partitions: (written.append(rows.count()), real(rows, path, keys)))
    assert {s for _, _, s in states(ld.Target(spark, target.root).load(tables, wanted)).values()} == {"ready"}
    assert written == [0, 0]  # what the first run wrote in full is only marked
    assert readable(target, tables) == {"facts": {0, 1, 2}, "notes": {0, 1, 2}}
    assert {s for _, _, s in states(target.load(tables, wanted)).values()} == {"loaded"} and written == [0, 0, 0, 0]
    assert target.markers().count() == 3


def test_partial_and_changed_bundles_are_refused(spark):
    tables = bundles(spark)
    wanted = ld.manifest(tables)
    target = ld.Target(spark, new_path(spark, "target"))
    short = tables | {"notes": tables["notes"].where("id <> 20")}  # bundle 2 lost a row
    found = states(target.load(short, wanted))
    assert found[(2, "notes")] == (3, False, "partial") and found[(2, "facts")] == (20, True, "partial") and found[(1, "notes")][2] == "ready"
    assert readable(target, tables) == {"facts": {0, 1}, "notes": {0, 1}}
    other = tables | {"facts": tables["facts"].withColumn("v", F.when(F.col("id") == 1, "").otherwise(F.col("v")))}
    changed = states(target.load(other, ld.manifest(other)))
    assert changed[(1, "facts")][2] == "changed" and changed[(0, "facts")][2] == "loaded" and changed[(2, "notes")][2] == "ready"
    assert target.read("facts", tables["facts"].schema).where("id = 1").first().v == "1"
    absent = ld.Target(spark, new_path(spark, "target"))
    assert {s for _, _, s in states(absent.verify(wanted, tables)).values()} == {"partial"}


def test_digest_tells_nulls_blanks_and_borders_apart(spark):
    rows = [("a", None), ("a", ""), (None, "a"), ("", "a"), ("a;1:b", "c"), ("a", "1:b;c"), ("n;", ""), ("ab", "c"), ("a", "bc")]
    digests = {ld.content(spark.createDataFrame([r], "x string, y string"), []).first().digest for r in rows}
    assert len(digests) == len(rows)
    many = spark.createDataFrame(rows, "x string, y string")
    assert ld.content(many, []).first() == ld.content(many.repartition(5), []).first()


def test_restore_goes_on_after_an_interruption(spark):
    path = new_path(spark, "restore")
    rows = spark.range(3000).select(F.concat(F.lit("00"), F.col("id") % 20).alias("ticker"), "id")
    ld.replace_partitions(rows.where("ticker = '003'").withColumn("id", F.lit(-1).cast("long")), path, ["ticker"])
    ld.restore_partitions(rows.where("id % 20 < 9"), path, "ticker")  # the run that was cut short
    ld.restore_partitions(rows, path, "ticker")
    once = sorted(tuple(r) for r in spark.read.schema("id long, ticker string").parquet(path).collect())
    ld.restore_partitions(rows, path, "ticker")
    again = sorted(tuple(r) for r in spark.read.schema("id long, ticker string").parquet(path).collect())
    assert once == again == sorted((-1 if r.ticker == "003" else r.id, r.ticker) for r in rows.collect())


def many_keys(spark, n=2000):
    """Four rows a ticker; the last ticker is null."""
    return spark.range(4 * n).select(F.when(F.col("id") % n < n - 1, F.format_string("%05d", F.col("id") % n)).alias("ticker"), "id")


def held(spark, path, rows):
    return sorted((tuple(r) for r in ld.read_partitions(spark, path, rows.schema, ["ticker"]).collect()), key=str)


def test_shared_partitions_are_restored_in_few_files(spark):
    path, rows = new_path(spark, "shared"), many_keys(spark)
    assert held(spark, path, rows) == []
    ld.replace_partitions(rows.where("ticker % 2 = 0").withColumn("id", -F.col("id")), path, ["ticker"], shared=True)
    ld.restore_partitions(rows.where("ticker % 6 = 1"), path, "ticker", shared=True)  # the run that was cut short
    first = set(spark.read.parquet(path).inputFiles())
    ld.restore_partitions(rows, path, "ticker", shared=True)
    once, files = held(spark, path, rows), set(spark.read.parquet(path).inputFiles())
    assert first < files and len(files) < 60
    assert once == sorted(((r.ticker, -r.id if r.ticker and int(r.ticker) % 2 == 0 else r.id) for r in rows.collect()), key=str)
    ld.restore_partitions(rows, path, "ticker", shared=True)
    assert held(spark, path, rows) == once and set(spark.read.parquet(path).inputFiles()) == files


def test_shared_partitions_of_an_interrupted_run_do_not_count(spark, monkeypatch):
    path, rows = new_path(spark, "shared"), many_keys(spark, 50)
    for before in ([], ["00003"]):
        with monkeypatch.context() as broken:
            broken.setattr(ld, "switch_partitions", lambda *_: (_ for _ in ()).throw(RuntimeError("executor lost")))
            with pytest.raises(RuntimeError):
                ld.restore_partitions(rows, path, "ticker", shared=True)
        assert sorted({t for t, _ in held(spark, path, rows)}) == before
        ld.restore_partitions(rows.where("ticker = '00003'"), path, "ticker", shared=True)
    ld.restore_partitions(rows, path, "ticker", shared=True)
    assert held(spark, path, rows) == sorted((tuple(r) for r in rows.collect()), key=str)


def test_a_folder_without_partitions_is_restored(spark):
    rows = many_keys(spark, 50)
    path = new_path(spark, "empty")
    ld.replace_partitions(rows.limit(0), path, ["ticker"])  # leaves a folder
    assert ld.listed_partitions(spark, path, "ticker").count() == 0
    ld.restore_partitions(rows, path, "ticker")
    assert spark.read.schema(rows.schema).parquet(path).count() == rows.count()
    shared = new_path(spark, "empty")
    ld.replace_partitions(rows.limit(0), shared, ["ticker"], shared=True)
    assert held(spark, shared, rows) == []
    ld.restore_partitions(rows, shared, "ticker", shared=True)
    assert len(held(spark, shared, rows)) == rows.count()


def test_a_replaced_shared_partition_is_read_from_its_newest_run(spark):
    path, rows = new_path(spark, "shared"), many_keys(spark, 50)
    again = rows.where("(ticker = '00007' or ticker is null) and id < 100").withColumn("id", F.col("id") + 1000)
    for part in (rows, again):
        ld.replace_partitions(part, path, ["ticker"], shared=True)
    ld.restore_partitions(rows, path, "ticker", shared=True)
    want = [tuple(r) for r in rows.where("ticker <> '00007'").collect()] + [("00007", 1007), ("00007", 1057), (None, 1049), (None, 1099)]
    assert held(spark, path, rows) == sorted(want, key=str)
    plan = ld.shared_partitions(spark, path, rows.select("ticker").schema)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "ReadSchema: struct<ticker:string>" in plan and "id:bigint" not in plan


def test_restored_tickers_share_their_files(spark, tmp_path):
    """The query over 300 tickers of three sessions: odd ones keep their own values, even ones are restored, null among them."""
    rows = spark.range(900).select((F.col("id") % 300).alias("k"), "id").select(
        F.when(F.col("k") > 0, F.col("k")).alias("l_suppkey"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / 300).cast("int")).alias("l_shipdate"),
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), (F.col("id") * 2.0).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["restore_missing_only"](spark, str(tmp_path))
    assert len(found.inputFiles()) < 60
    name = lambda k: f"S{k}" if k else None
    want = [(name(i % 300), dt.date(2024, 1, 1 + i // 300), float(-i if i % 2 else i)) for i in range(900)]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)


def test_existing_partitions_are_listed_not_read(spark):
    path = new_path(spark, "listed")
    rows = spark.range(100).select((F.col("id") % 4).cast("string").alias("ticker"), "id")
    ld.replace_partitions(rows, path, ["ticker"])
    listed = ld.listed_partitions(spark, path, "ticker")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "parquet" not in plan.split("Format: ")[-1].split(",")[0].lower()
    assert sorted(r.ticker for r in listed.collect()) == ["0", "1", "2", "3"]
    assert ld.listed_partitions(spark, new_path(spark, "absent"), "ticker").collect() == []


def test_replaced_dates_leave_others_alone(spark):
    path = new_path(spark, "dates")
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("day"), "id")
    ld.replace_partitions(rows, path, ["day"])
    others = lambda: {f for f in spark.read.parquet(path).inputFiles() if "/day=3/" not in f}
    before = others()
    ld.replace_partitions(rows.where("day = 3 and id < 10"), path, ["day"])
    assert others() == before and len(before) == 3
    assert sorted(r.id for r in spark.read.parquet(path).where("day = 3").collect()) == [3, 7]


def test_pointer_is_replaced(spark):
    path = new_path(spark, "pointer")
    assert read_pointer(spark, path) is None
    for content in ("one", "zwei ü"):
        replace_pointer(spark, path, content)
        assert read_pointer(spark, path) == content


def test_lookup_reads_the_files_of_its_ticker(spark):
    start = dt.date(2020, 1, 1)
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 40)).alias("ticker"),
                                    F.date_add(F.lit(start), (F.col("id") / 3).cast("int")).alias("date"), "id")
    root = new_path(spark, "layout")
    publish_clustered(rows, root, "date", file_rows=200)
    table = Clustered(spark, root)
    files = len(table.rows.inputFiles())
    assert files > 15
    one = table.of(["T7"])
    holding = {r.file for r in table.index.where("key = 'T7'").collect()}
    assert len(one.inputFiles()) == len(holding) <= 2
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in rows.where("ticker = 'T7'").collect())
    last = table.newest(["HOT"], 5)
    assert len(last.inputFiles()) <= 2
    want = [r.id for r in rows.where("ticker = 'HOT'").orderBy(F.desc("date")).limit(5).collect()]
    assert [r.id for r in last.orderBy(F.desc("date")).limit(5).collect()] == want
    some = table.of(["HOT"], dt.date(2021, 1, 1), dt.date(2021, 1, 31))
    assert len(some.inputFiles()) <= 2 and some.where("date >= '2021-01-01' and date <= '2021-01-31'").count() == 31
    assert table.of(["ABSENT"]).count() == 0
    assert {(r.ticker, r.rows) for r in table.keys().collect()} == {(r.ticker, r["count"]) for r in rows.groupBy("ticker").count().collect()}
    publish_clustered(rows.where("id < 30"), root, "date")
    assert Clustered(spark, root).rows.count() == 30 and table.rows.count() == 4000
