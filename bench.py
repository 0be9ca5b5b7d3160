"""Times every registered query and prints one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Each query runs once to warm up and
then ``BENCH_RUNS`` times; its figure is the median. Results go to Spark's
``noop`` sink, so all rows and columns are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pulseplan.plans.catalog import all_queries  # noqa: E402


def _timed(query, spark: SparkSession, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in all_queries().items():
        if only and name not in only:
            continue
        _timed(query, spark, sf_dir)
        times = [_timed(query, spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name:28s} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
