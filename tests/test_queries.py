"""Registered queries against their SQL on the smallest tables.

A representative set runs by default; TAPEFRAME_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from tapeframe.plans.registry import QUERIES as LIBRARY
from tests.conftest import FOLDER
from tools.check import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = ["sma_20_50_100_200", "asof_calendar_return", "strict_session_return", "fa_score", "asof_fa", "ta_snapshot", "final_action",
        "job_prices", "job_financials", "full_outer_reconcile", "adjust_prices", "merge_financial_sources", "ledger_positions",
        "topn_returns", "advance_state", "assign_actions", "validate_layer", "star_facts", "company_match", "stream_session_candle",
        "stream_quota", "stream_upsert_lineage", "stream_upsert_removals", "stream_live_marks", "load_once_guard", "restore_missing_only",
        "sink_replace_dates", "ledger_replay_hot", "rsi_wilder", "q_prices", "q_diagnostics", "refetch_reasons", "validate_bundle"]
NAMES = list(LIBRARY) if os.environ.get("TAPEFRAME_ALL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_query_has_checking_sql():
    assert set(LIBRARY) <= set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
