"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) chooses the data, BENCH_CPUS (default 8) the local threads,
BENCH_QUERIES (comma separated) a subset.
"""

from __future__ import annotations

import json
import os
import time

from wardline.plans import catalogue
from wardline.session import build_session

HEADLINE = (
    "v01_valid_rows", "f01_f05_f07_f08_f18_minute_windows", "f16_travel", "f31_active_sessions", "p07_p09_p10_p15_baseline",
    "p06_f06_f25_novelty", "f17_f22_f26_f27_f29_f30_histories", "f21_f28_f32_ranges", "f01_f32_vector", "m02_scaler_transform",
    "m05_forest_scores", "m17_sequence_window", "r02_r03_r06_r07_risk", "r13_alert_threshold", "r15_budget", "i02_incidents",
    "i05_alert_timelines", "b01_daily_rollup", "b05_identity_ranking", "d06_d07_d14_findings", "e04_e05_class_report",
    "e06_e07_m25_ranking_quality", "e08_cold_start", "p14_profile_summary", "p16_live_profiles",
)
WARM_UP = "v01_valid_rows"  # run once untimed, so that no query pays for the start of the session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(f"local[{cpus}]", "wardline-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": str(4 << 20)})
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    catalogue.QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    full = times.get("f01_f32_vector")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "events": events, "feature_events_per_second": round(events / full, 1) if full else None}))
    spark.stop()


if __name__ == "__main__":
    main()
