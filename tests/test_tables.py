"""Published versions, item maps, medians, exits and search samples."""

import datetime as dt
import statistics

from pyspark.sql import functions as F

from tapeframe.operators import research as rs
from tapeframe.operators.ranking import grouped_median
from tapeframe.operators.serving import latest_period_items
from tapeframe.params import ACTIVE
from tapeframe.runtime import new_path
from tapeframe.sources import tables as tb


def test_version_ten_follows_nine(spark):
    root = new_path(spark, "versions")
    for version in ("9", "10"):
        tb.publish(spark.range(1).withColumn("v", F.lit(version)), root, "t", version)
    assert tb.read_published(spark, root, "t").first()["v"] == "10"


def test_item_code_in_two_statements(spark):
    end = dt.date(2024, 12, 31)
    rows = spark.createDataFrame([("A", end, "eps", "income_statement", 1.0), ("A", end, "eps", "balance_sheet", 2.0), ("A", dt.date(2023, 12, 31), "eps", "x", 3.0)],
                                 "ticker string, period_end date, item_code string, statement string, value double")
    assert latest_period_items(rows).first()["items"] == {"eps": 1.0}


def test_median_of_all_values(spark):
    values = [-5.0, -0.25, 0.0, 0.0, 3.5, 1e-9, 7.0]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", -1.0), ("b", -2.0), ("b", None)], "g string, v double")
    got = {r.g: r["median"] for r in grouped_median(frame, ["g"], "v", positive=False).collect()}
    assert got == {"a": statistics.median(values), "b": -1.5}
    assert {r.g for r in grouped_median(frame, ["g"], "v").collect()} == {"a"}


def test_exit_is_the_next_one(spark):
    held = [0, 1, 1, 0, 0, 1, 0, 1]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), float(i), h) for i, h in enumerate(held)], "ticker string, date date, px double, held int")
    got = sorted((r.entry_bar, r.exit_bar) for r in rs.position_changes(rows).collect() if r.exit_bar) 
    assert got == [(2, 4), (6, 7)]


def test_a_longer_sample_keeps_the_shorter_one():
    axes = {"entry_score": (30.0, 40.0, 50.0), "fa_weight": (0.1, 0.2), "profile": tuple(rs.PROFILES)}
    short, long = rs.grid(ACTIVE, axes, 6), rs.grid(ACTIVE, axes, 20)
    assert long[:6] == short and len({c["name"] for c in long}) == 20
    assert len(rs.grid(ACTIVE, axes, 1000)) <= 1 + 24


def test_variants_of_a_family_differ():
    for family in (rs.ablations(ACTIVE), rs.experiments(ACTIVE), rs.neighbours(rs.config(0, "baseline", ACTIVE), 100)):
        keys = [tuple(v for k, v in c.items() if k not in ("config", "parent", "name")) for c in family]
        assert len(set(keys)) == len(keys)
