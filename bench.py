"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
``sensor_flow`` is raw text to aggregates on generated sensor days: one hour at
1 Hz with 13 channels for every supplier.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidegrid.catalog import all_queries  # noqa: E402
from tidegrid.catalog.base import table  # noqa: E402
from tidegrid.plans.flow import FlowStep, run_flow  # noqa: E402
from tidegrid.session import local_session, scratch_path  # noqa: E402
from tidegrid.sources import synthetic  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
DEVICE_HOURS = int(os.environ.get("BENCH_DEVICE_HOURS", "200"))

HEADLINE = (
    "kv_parse",
    "clean",
    "mask_spikes",
    "collapse_second",
    "resample",
    "tumble_hour",
    "tumble_dense",
    "multi_window",
    "fit_percentile",
    "normalize",
    "export_long",
    "pivot_wide",
    "merge_append",
    "row_counts",
    "latest_run",
    "scalar_transforms",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    began = time.perf_counter()
    run(make())
    return time.perf_counter() - began


def sensor_source(spark) -> tuple[str, int]:
    """Raw lines of the generated device-hours, written once in folders per file name."""
    devices = table(spark, SF_DIR, "supplier").select(
        F.col("s_name").alias("device_id"), F.col("s_suppkey").alias("device_no")
    )
    devices = devices.orderBy("device_no").limit(DEVICE_HOURS)
    lines = synthetic.raw_lines(synthetic.sensor_days(devices, days=1, hours=1))
    day = F.date_format("file_day", "yyyy-MM-dd")
    named = lines.withColumn("name", F.concat_ws("_", "experience", "device_id", day))
    path = scratch_path(spark, "bench-raw")
    named.repartition(int(CPUS) * 4, "name").sortWithinPartitions("name", "value").select(
        "name", "value"
    ).write.partitionBy("name").text(path)
    return path, spark.read.text(path).count()


def sensor_flow(spark, path: str):
    keys = [f"m{i}" for i in range(synthetic.CHANNELS)] + ["outdoor_temp"]
    steps = [
        FlowStep("parse", {"keys": keys}),
        FlowStep("clean"),
        FlowStep("resample"),
        FlowStep("transform"),
        FlowStep("aggregate", {"windows": ["10s", "60s", "5min", "1h"]}),
    ]
    tables = run_flow(steps, spark=spark, source=path, params={"split": False})
    out = None
    for domain_table in tables.values():
        out = domain_table if out is None else out.unionByName(domain_table, allowMissingColumns=True)
    return out


def main() -> None:
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "12g"), app="bench")
    known = all_queries()
    times = {}
    for name in HEADLINE:
        make = lambda: known[name].run(spark, SF_DIR)  # noqa: B023, E731
        timed(make)
        times[name] = round(statistics.median(timed(make) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    path, n_lines = sensor_source(spark)
    make = lambda: sensor_flow(spark, path)
    timed(make)
    times["sensor_flow"] = round(statistics.median(timed(make) for _ in range(max(1, RUNS - 1))), 3)
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1],
        "sensor_flow_lines": n_lines,
        "sensor_flow_lines_per_sec": round(n_lines / times["sensor_flow"]),
        "cpus": int(CPUS) if CPUS.isdigit() else CPUS,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
