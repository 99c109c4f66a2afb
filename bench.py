"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) select
the data and the number of local threads. Each query is written to a sink that
discards rows, once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ohlc_daily", "ohlc_daily_bars", "ohlc_interval_1m", "ohlc_interval_1h", "first_last_value", "ticks_between",
    "big_movers_since", "latest_for_symbols_ties", "latest_tick", "stock_statistics_bars", "trending_by_volume",
    "distinct_symbols", "database_stats", "tick_returns", "rolling_average", "enrich_processed", "tick_page",
    "window_price_stats", "price_change_alerts", "volume_anomalies", "all_stock_alerts", "score_sentiment",
    "extract_symbols", "trading_signals", "news_alerts", "breaking_news_pattern", "window_sentiment_mean",
    "window_sentiment_pairwise", "period_statistics_1M", "market_summary", "high_low_52w", "trending_with_ratio",
    "user_profiles", "watchlist_quotes", "daily_digest", "route_alerts", "route_alerts_per_day", "route_news_alerts",
    "update_alerts", "apply_delivery_results", "notify_stock_alert", "parse_stock_json", "parse_stock_json_lenient",
    "merge_processed", "check_unique_keys",
]


def main():
    from quotelake.plans import registry
    from quotelake.session import build_session

    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quotelake-")})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
        print(f"{name:32s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
