"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tapeframe.plans import load_all
from tapeframe.plans.registry import QUERIES
from tapeframe.runtime import build_session

HEADLINE = ["sma_20_50_100_200", "asof_calendar_return", "ta_history", "job_prices", "full_outer_reconcile", "adjust_prices",
            "merge_financial_sources", "fa_score", "asof_fa", "final_action", "rankings", "assign_actions", "ledger_replay",
            "ledger_positions", "sweep_scores", "performance", "validate_bundle", "company_match", "stream_session_candle"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(f"local[{cpus}]", "bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
