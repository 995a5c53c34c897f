"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallywise.catalogue import load
from tallywise.session import local_session

HEADLINES = ["account_balances", "spend_by_currency", "possible_duplicates", "suspect_amounts", "suspect_rates",
             "running_balance", "bank_order", "chain_check", "assign_occurrence", "classify_duplicates", "bank_months",
             "search"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tallywise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    seconds = {}
    # One warm-up so the first query does not pay for starting the engine.
    queries["account_balances"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
