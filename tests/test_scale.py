"""Steps whose size must not follow the number of tickers, accounts or files."""

import datetime as dt
import itertools
import random
import re

from pyspark.sql import functions as F

from tapeframe.functions.cleaning import number_token
from tapeframe.operators import clean, ledger as lg, research as rs, signals as sg, textmatch as tm, windows as w
from tapeframe.params import ON_FIXTURES
from tapeframe.runtime import new_path, stage
from tapeframe.sources import tables as tb
from tapeframe.sources.driver import Market
from tapeframe.streaming import jobs


def _history(spark, tickers):
    """Three sessions; half of the tickers share scores, some are nearer to each other than rounding shows."""
    rng, rows = random.Random(5), []
    for day, n in itertools.product(range(3), range(tickers)):
        fa = rng.choice([40.0, 60.0, rng.uniform(20, 90), 60.0 + rng.choice([-1, 1]) * 1e-6 * rng.random(), float("nan") if n % 50 == 49 else 61.0])
        up = lambda p=0.8: rng.choice([1.0, 1.0, -1.0]) if rng.random() < p else None
        rows.append((f"S{n}", dt.date(2024, 1, 2 + day), fa, True, up(), up(), rng.choice([0.5, 0.5, 0.7]), up(), 10.0, rng.choice([9.0, 11.0]), 9.5,
                     rng.choice([9.0, 10.0]), rng.choice([0.5, 0.9, 1.1, 1.3, None]), rng.choice([4e4, 6e4, 2e5, None]), 0.02, 5.0, 4.0, 6.0, None))
    schema = ("ticker string, date date, effective_fa double, fa_eligible boolean, r3 double, r6 double, r12 double, rs6 double, px double, ma50 double, ma200 double,"
              "high_close20 double, volume_ratio double, avg_trading_value20 double, volatility20 double, bm_px double, bm_ma50 double, bm_ma100 double, bm_ma200 double")
    return spark.createDataFrame(rows, schema)


def test_contenders_hold_every_member_and_stay_bounded(spark):
    axes = {"fa_weight": (0.1, 0.4), "profile": ("balanced", "momentum_quality"), "entry_score": (20.0, 40.0), "minimum_volume_ratio": (0.8, 1.2),
            "regime_ma": (50, 100), "max_positions": (2, 4), "minimum_trading_value": (5e4, 1e5)}
    configs = rs.grid(ON_FIXTURES.with_(entry_score=20.0, max_positions=3), axes, 40)
    history = _history(spark, 1500).cache()
    picked = lambda **most: {(r.config, r.date, r.ticker, r.rank) for r in rs.members(rs.sweep_panel(history, configs, **most), 4).collect()}
    assert picked(most=4) == picked() != set()
    session = F.countDistinct("ticker").alias("n")
    left, whole = (rs.sweep_panel(history, configs, **most).groupBy("date").agg(session).agg(F.max("n")).first()[0] for most in ({"most": 4}, {}))
    assert left < whole / 2


def test_longer_frames_are_those_of_a_pass_over_all_their_rows(spark):
    rng = random.Random(7)
    rows = [(t, dt.date(2023, 1, 1) + dt.timedelta(days=i), rng.choice([1.0, 2.5, 10.0, rng.uniform(1, 9)]) if t == "A" or rng.random() < 0.99 else None)
            for t in "AB" for i in range(450)]
    bars = w.with_running_count(spark.createDataFrame(rows, "ticker string, date date, px double"), "px")
    out = w.with_blocks(bars, "px").select(
        *[F.abs(F.when(w.all_present("px", n), F.col(f"_n_sum{n}") / n) - w.rolling(F.avg, "px", n)).alias(f"ma{n}") for n in (20, 50, 100, 200)],
        *[F.abs(F.when(w.all_present("px", n, 1), F.col(f"_n_max{n}")) - w.rolling(F.max, "px", n, 1)).alias(f"high{n}") for n in (20, 60)],
        *[w.rolling(F.avg, "px", n).alias(f"whole{n}") for n in (20, 200)]).collect()
    for name in ("ma20", "ma50", "ma100", "ma200", "high20", "high60"):
        off = [r[name] for r in out if r[name] is not None]
        assert off and max(off) < 1e-12
    assert [r.ma200 is None for r in out] == [r.whole200 is None for r in out]


def test_an_account_at_its_cash_limit_needs_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.choice(["BUY", "BUY", "SELL"]), f"S{rng.randrange(3)}", rng.randrange(1, 9), round(rng.uniform(5, 90), 2), dt.date(2024, 1, 2)) for i in range(3000)]
    orders = spark.createDataFrame(rows, "id long, account long, side string, ticker string, quantity long, price double, market_date date")
    rounds, kept = [], lg.stage
    monkeypatch.setattr(lg, "stage", lambda frame, name: rounds.append(name) or kept(frame, name))
    decided = lambda chunk: sorted((r.id, r.account, r.status, round(r.cash_after, 4)) for r in lg.replay(orders, 2000.0, chunk=chunk).collect())
    assert decided(60) == decided(10_000)
    assert len({r[2] for r in decided(10_000)}) == 3 and rounds.count("slices") <= lg.ROUNDS + 1


def test_the_log_of_revisions_is_written_by_many_tasks(spark):
    schema = "ticker string, date date, open double, high double, low double, close double, volume double, source string, row_checksum string, source_checksum string"
    bars = lambda mark: spark.createDataFrame(
        [(f"S{n}", dt.date(2024, 1 + n % 3, 2), 1.0, 1.0, 1.0, 1.0, 1.0, "DNSE", f"{mark}{n}", f"{mark}{n}") for n in range(200)], schema)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = jobs.upsert_lineage(jobs.feed_of([bars("a"), bars("b")], "bar_feed"), "2024-02-01T00:00:00", "bars")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert table.revisions().count() == 200 and len(table.revisions().inputFiles()) > 1
    assert table.rows().count() == 200 and {r.data_version for r in table.rows().collect()} == {2}


def test_documents_are_not_the_side_that_is_broadcast(spark):
    docs = spark.createDataFrame([(i, "Alpha bravo news", "charlie delta " * 3) for i in range(50)], "doc_id long, title string, content string")
    names = spark.createDataFrame([("AAA", "alpha bravo"), ("DELTA", "unknown thing")], "ticker string, company_name string")
    matched = tm.company_match(docs, names)
    assert {(r.doc_id, r.ticker) for r in matched.collect()} == {(i, t) for i in range(50) for t in ("AAA", "DELTA")}
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_cleaning_of_prices_is_code_the_jvm_compiles(spark):
    """The formatter stands there once, not for every number; methods of more than 8 000 bytes are interpreted for good."""
    landed = spark.createDataFrame([(" s1 ", "2024-01-05 00:00:00", 1.5, 2.0, 1.0, 1.25, 10.0, "DNSE")],
                                   "ticker string, date string, open double, high double, low double, close double, volume double, source string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = clean.prices(landed)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) <= 8_000, sizes
    simple = clean.prices(landed)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert simple.count("format_string") == 1


def test_published_rows_are_finished_in_their_place(spark, monkeypatch):
    """Checksums are neither staged nor shuffled: only chosen rows are moved, and the published table is the cleaned one."""
    from tapeframe.plans import quality
    from tapeframe.sources import layout
    staged = []
    monkeypatch.setattr(layout, "stage", lambda rows, name: staged.append(rows.columns) or stage(rows, name))
    root = new_path(spark, "published")
    landed = spark.createDataFrame([(f" s{n % 3} ", f"2024-01-{n + 1:02d} 00:00:00", 1.5, 2.0, 1.0 if n % 4 else 3.0, 1.25, 10.0, "DNSE") for n in range(20)],
                                   "ticker string, date string, open double, high double, low double, close double, volume double, source string")
    monkeypatch.setattr(quality.Market, "bars", None)
    monkeypatch.setattr(quality.L, "prices", lambda bars: landed)
    for name in ("lineitem", "part", "supplier", "nation", "region"):
        spark.range(1).write.parquet(f"{root}/{name}.parquet")
    got = quality.Serving(spark, root).prices().rows
    want = clean.prices(landed).filter("analysis_ready")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert len(staged) == 1 and "row_checksum" not in staged[0]


def test_number_tokens_are_the_eight_decimals(spark):
    values = [0.0, -0.0, 1.5, 100.0, -2.25, 0.001, 0.0005, 1e-9, 5e-9, 1.005, 0.1 + 0.2, 1e7, 1e7 + 0.25, 9999999.99999999, 123456789.0, 1e15, 1e20, float("nan"), float("inf"), None]
    formatted = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", "x"), "0+$", ""), r"\.$", "")
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", number_token(F.col("x")).alias("token"), formatted.alias("want")).collect()
    assert [r.token for r in rows] == ["" if r.x is None or r.x != r.x or abs(r.x) == float("inf") else r.want for r in rows]


def _formatted(spark, build):
    """The static plan in detail, one block a node."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return build()._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _moved(plan, key):
    """Columns of every shuffle by the key."""
    return [re.sub(r"#\d+L?", "", columns).split(", ") for columns in re.findall(rf"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\({key}#", plan)]


def test_trades_move_as_they_are(spark):
    root = new_path(spark, "market")
    rows = [(o, o % 3, 1 + o % 2, float(o % 4), 10.0 * o + n, dt.datetime(2024, 1, 1 + o % 5)) for o in range(60) for n in (0, 0.5)] + [(99, None, 1, 2.0, 5.0, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(
        f"{root}/lineitem.parquet")
    moved = _moved(_formatted(spark, lambda: Market(spark, root).bars), "l_suppkey")
    assert [sorted(x) for x in moved] == [["date", "l_extendedprice", "l_linenumber", "l_orderkey", "l_quantity", "l_suppkey"]]
    want = {}
    for order, key, line, quantity, price, at in rows:
        if quantity > 0:
            want.setdefault((f"S{key}" if key is not None else None, at and at.date()), []).append((order * 100 + line, price / quantity, quantity))
    got = {(r.ticker, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in Market(spark, root).bars.collect()}
    assert got == {k: (min(v)[1], max(x[1] for x in v), min(x[1] for x in v), max(v)[1], sum(x[2] for x in v)) for k, v in want.items()}


def test_bars_move_once_and_before_they_get_index_columns(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    bars = spark.createDataFrame([(t, d, 5.0 + i, 10.0, 50.0) for t in ("A", "B", None) for i, d in enumerate(days)],
                                 "ticker string, date date, close double, volume double, trading_value double")
    index = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(days)], "date date, close double")
    for build in (lambda: sg.ta_history(bars, index), lambda: sg.ta_latest(bars, index, ON_FIXTURES)):
        plan = _formatted(spark, build)
        assert not [x for x in _moved(plan, "date") if "px" in x]  # only the calendar itself
        assert [sorted(x) for x in _moved(plan, "ticker")] == [["date", "px", "ticker", "trading_value", "volume"]]
        assert build().filter("ticker IS NULL").count() > 0


def test_bars_move_to_their_session_as_conditions(spark):
    configs = rs.grid(ON_FIXTURES.with_(entry_score=20.0), {"minimum_volume_ratio": (0.8, 1.2), "regime_ma": (50, 100), "minimum_trading_value": (5e4, 1e5)}, 8)
    plan = _formatted(spark, lambda: rs.sweep_panel(_history(spark, 20), configs, most=4))
    moved, = _moved(plan, "date")
    assert not {"r3", "ma50", "ma200", "high_close20", "bm_px", "bm_ma50", "bm_ma200"} & set(moved) and {"momentum", "regime50", "volume_ratio"} <= set(moved)
    bear = _history(spark, 20).withColumn("bm_px", F.lit(1.0))  # under every average: nothing can enter
    assert "bm_px" in plan and rs.sweep_panel(bear, configs).count() == 0 < rs.sweep_panel(_history(spark, 20), configs).count()


def test_bars_with_their_neighbours_are_fewer_and_stay_where_they_are(spark):
    configs = rs.grid(ON_FIXTURES.with_(entry_score=20.0), {"minimum_volume_ratio": (0.8, 1.2), "regime_ma": (50, 100), "minimum_trading_value": (5e4, 1e5)}, 8)
    history = _history(spark, 300).withColumn("r12", F.when(~F.col("ticker").endswith("7"), F.col("r12")))
    history = spark.createDataFrame(history.collect(), history.schema)
    kept = stage(rs.with_neighbours(history), "history")
    assert 0 < kept.count() == history.filter("r12 IS NOT NULL").count() < history.count() and not {"ma20", "volatility20"} & set(kept.columns)
    once, anew = (rs.sweep_panel(rows, configs, most=4) for rows in (kept, history))
    assert sorted(map(str, once.collect())) == sorted(map(str, anew.collect())) != []
    once, anew = (frame._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(ticker") for frame in (once, anew))
    assert once == 0 < anew


def test_a_reached_step_compares_as_its_value_does(spark):
    values = [None, 0.5, 0.8, 0.9, 1.2, 7.0, float("nan"), float("inf"), -1.0]
    steps = [0.8, 1.0, 1.2]
    rows = spark.createDataFrame([(v,) for v in values], "x double").withColumn("step", rs.reached("x", steps))
    for step in steps:
        assert rows.filter(F.coalesce(F.col("x") >= step, F.lit(False)) != F.coalesce(F.col("step") >= step, F.lit(False))).count() == 0


def test_ticker_folders_are_written_by_many_tasks(spark):
    rows = spark.createDataFrame([(f"s{n}", f"Company {n}") for n in range(40)], "ticker string, company_name string")
    path = tb.write_ticker_files(rows, "metadata", "json")
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path").collect()]
    assert len(files) == len({re.search("folder=([^/]+)/", f)[1] for f in files}) == 40
    assert len({re.search(r"/part-(\d+)-", f)[1] for f in files}) >= 4
    read = tb.last_per_ticker(tb.read_ticker_files(spark, path, "company_name string", "json", multi_line=True))
    assert {(r.ticker, r.company_name) for r in read.collect()} == {(f"S{n}", f"Company {n}") for n in range(40)}
