"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Base tables are derived and stored once (``load_tables``), and distributions and thresholds are
fitted once (``refresh``), as they would be between two arrivals of observations. Every query then
corrects and scores all stations and is run to completion without collecting its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stagecast.session import local_session  # noqa: E402
from verification import queries  # noqa: E402

HEADLINE = (
    "series_scan", "ensemble_wide", "monthly_histogram", "monthly_cdf", "corrected_simulation",
    "annual_maxima", "return_periods", "corrected_forecast", "corrected_records", "ensemble_stats",
    "ensemble_daily_max", "exceedance_daily", "warnings_wide", "probability_table", "water_level_alerts",
    "daily_average", "monthly_average", "skill_metrics", "metrics_comparison", "historical_series",
    "forecast_series", "export_corrected_sim", "stream_ingest", "stream_daily_max",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    runs = queries.registry()

    def load() -> None:
        for table in vars(queries.context(spark, folder).tables).values():
            table.write.format("noop").mode("overwrite").save()

    times = {"load_tables": timed(load), "refresh": timed(lambda: queries.context(spark, folder).state())}
    for name in names:
        times[name] = timed(lambda: runs[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores,
    }))


if __name__ == "__main__":
    main()
