"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores, BENCH_KEYS a comma list of
queries, BENCH_RUNS the timed runs after one warm-up. A query's time covers building and running it into
the no-op sink; the reported figure is the median run.
"""

import json
import logging
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickforge.registry import load  # noqa: E402
from tickforge.session import build_session  # noqa: E402

HEADLINE = [
    "klines", "order_current_state", "depth_rebuild", "balance_history", "orders_by_user", "symbol_stats", "volume_timeseries",
    "unique_traders_series", "user_activity_hourly", "mid_price_asof", "slippage_hourly", "capital_flow", "book_history_hourly",
    "positions_fold", "pnl_backfill_hourly", "pnl_lb_30d", "data_gaps", "rate_limit", "stream_klines",
]
ROWS = ("klines", "slippage_hourly", "book_history_hourly", "pnl_backfill_hourly", "stream_klines")


def main() -> None:
    logging.disable(logging.WARNING)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    keys = os.environ["BENCH_KEYS"].split(",") if os.environ.get("BENCH_KEYS") else HEADLINE
    spark = build_session("tickforge-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries = load().spark_queries()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    for key in keys:
        taken = []
        for _ in range(runs + 1):
            t0 = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(taken[1:] or taken), 3)
    name = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(name[2:]) if name.startswith("sf") else name, "events": events,
        "events_per_sec": {k: round(events / times[k]) for k in ROWS if k in times and times[k] > 0}}))
    spark.stop()


if __name__ == "__main__":
    main()
