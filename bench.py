"""Wall time of the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from tickerloom.plans.queries import QUERIES
from tickerloom.session import local_session

HEADLINE = [
    "sql_daily_panel", "weekly_bars", "direction", "news_lag_join", "ma5_by_ticker", "summary_stats", "size_class",
    "token_counts", "hash_embedding", "metrics_by_year", "best_model_by_year", "cost_adjusted_returns",
    "portfolio_returns", "risk_table", "walk_forward_predict",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        warm = sorted(times[1:])
        seconds[name] = round(warm[len(warm) // 2], 3)
        print(f"{name}: first {times[0]:.2f} s, warm {seconds[name]:.2f} s", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf,
    }))


if __name__ == "__main__":
    main()
