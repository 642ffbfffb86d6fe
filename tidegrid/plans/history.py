"""Run events: writing them and questions about past runs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.keys import null_safe_join

from tidegrid.session import delete_paths, folder_path
from tidegrid.sources.events import RUN_EVENT
from tidegrid.sources.stage import stage_outputs

# Parameters never written in clear, and days of events kept.
SECRET_PARAMS = ("password",)
RETENTION_DAYS = 30
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def new_run_id() -> str:
    return uuid.uuid4().hex[:8]


def mask_secrets(events: DataFrame, secrets: Sequence[str] = SECRET_PARAMS) -> DataFrame:
    return events.withColumn(
        "params",
        F.transform_values("params", lambda k, v: F.when(k.isin(list(secrets)), "***").otherwise(v)),
    )


def log_event(
    spark: SparkSession,
    path: str,
    treatment: str,
    status: str,
    input_dir: str = "",
    output_dir: str = "",
    *,
    run_id: str | None = None,
    flow: str | None = None,
    time_from: str | None = None,
    time_to: str | None = None,
    params: Mapping | None = None,
    duration_ms: float | None = None,
    error: str | None = None,
    ts: datetime | None = None,
) -> None:
    """Append one event, partitioned by day. Secret parameters are masked."""
    stamp = ts or datetime.now(timezone.utc)
    row = {
        "ts": stamp,
        "treatment": treatment,
        "status": status,
        "input_dir": input_dir,
        "output_dir": output_dir,
        "run_id": run_id,
        "flow": flow,
        "time_from": time_from,
        "time_to": time_to,
        "params": None if params is None else {k: str(v) for k, v in params.items()},
        "duration_ms": None if duration_ms is None else round(float(duration_ms), 1),
        "error": error,
    }
    event = mask_secrets(spark.createDataFrame([row], RUN_EVENT))
    event.withColumn("day", F.to_date("ts")).coalesce(1).write.mode("append").partitionBy("day").option(
        "timestampFormat", EVENT_TIME
    ).json(path)


def events_for_run(events: DataFrame, run_id: str, flow: str | None = None) -> DataFrame:
    picked = events.filter(F.col("run_id") == run_id)
    if flow is not None:
        picked = picked.filter(F.col("flow") == flow)
    return picked.orderBy("ts")


def run_summaries(events: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One row per run: status, start, end, steps done and failed.

    Any error makes it ``error``; as many steps done or skipped as the flow has make
    it ``success``; otherwise it is ``running``. ``steps`` has ``flow`` and
    ``n_steps``.
    """
    runs = events.groupBy("run_id", "flow").agg(
        F.min("ts").alias("ts_start"),
        F.max("ts").alias("ts_end"),
        F.count_if(F.col("status").isin("success", "skip")).alias("n_done"),
        F.count_if(F.col("status") == "error").alias("n_failed"),
    )
    if steps is None:
        runs = runs.withColumn("n_steps", F.lit(0).cast("long"))
    else:
        runs = runs.join(steps.select("flow", F.col("n_steps").cast("long")), "flow", "left").fillna(
            0, ["n_steps"]
        )
    status = (
        F.when(F.col("n_failed") > 0, "error")
        .when((F.col("n_steps") > 0) & (F.col("n_done") >= F.col("n_steps")), "success")
        .otherwise("running")
    )
    return runs.select(
        "run_id", "flow", status.alias("status"), "ts_start", "ts_end", "n_steps", "n_done", "n_failed"
    )


def run_outcomes(events: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``run_summaries`` with the time the run took and its first error's step and text.

    ``duration_ms`` adds up the steps' own times; a lazy step counts in the step that computed it.
    """
    failed = F.col("status") == "error"
    first = F.min_by(F.struct("treatment", "error"), F.when(failed, F.col("ts")))
    more = events.groupBy("run_id", "flow").agg(
        F.sum(F.when(F.col("status").isin("success", "error", "skip"), F.col("duration_ms"))).alias("duration_ms"),
        first.alias("_first"),
    )
    facts = more.select(
        "run_id", "flow", "duration_ms", F.col("_first.treatment").alias("failed_step"), F.col("_first.error").alias("error")
    )
    return null_safe_join(run_summaries(events, steps), facts, ["run_id", "flow"])


def run_status(events: DataFrame, run_id: str, steps: DataFrame | None = None) -> DataFrame:
    return run_summaries(events.filter(F.col("run_id") == run_id), steps)


def latest_run_per_flow(summaries: DataFrame) -> DataFrame:
    """The newest run of each flow.

    ``max_by`` combines map-side; a window would gather all runs of a flow.
    """
    rest = [c for c in summaries.columns if c != "flow"]
    order = F.struct("ts_start", "run_id")
    newest = summaries.groupBy("flow").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select("flow", "_r.*").orderBy(F.desc("ts_start"), "flow")


def recent_runs(summaries: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first."""
    return summaries.orderBy(F.desc("ts_start"), F.desc("run_id")).limit(limit)


def stage_status(
    spark: SparkSession, stages: Mapping[str, str], external: Sequence[str] = ()
) -> DataFrame:
    """Per stage: number of output files and last modification.

    ``dataset_status`` is ``up-to-date`` when every non-external stage has output.
    """
    rows = None
    for stage, path in stages.items():
        empty = spark.range(1).select(
            F.lit(stage).alias("stage"),
            F.lit(0).cast("long").alias("n_files"),
            F.lit(None).cast("timestamp").alias("last_modified"),
        )
        try:
            row = stage_outputs(spark, path).agg(
                F.count(F.lit(1)).alias("n_files"), F.max("modificationTime").alias("last_modified")
            ).select(F.lit(stage).alias("stage"), "n_files", "last_modified")
        except AnalysisException:
            row = empty
        rows = row if rows is None else rows.unionByName(row)
    counted = F.col("external") | (F.col("n_files") > 0)
    marked = rows.withColumn("external", F.col("stage").isin(list(external)))
    # One row per listed stage, so the window holds a handful of rows.
    complete = F.bool_and(counted).over(Window.partitionBy(F.lit(0)))
    return marked.select(
        "stage",
        "n_files",
        F.to_date("last_modified").alias("last_modified"),
        "external",
        F.when(complete, "up-to-date").otherwise("incomplete").alias("dataset_status"),
    )


def prune_events(events: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Events of the last ``days`` days; a predicate on ``day`` where the table has it."""
    cutoff = now - timedelta(days=days)
    kept = events.filter(F.col("ts") >= F.lit(cutoff))
    if "day" in events.columns:
        kept = kept.filter(F.col("day") >= F.lit(cutoff.date()))
    return kept


def delete_events(spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the log's folders of days older than ``days`` days; returns the days deleted."""
    oldest = (now - timedelta(days=days)).date()
    # One row per day of the log.
    listed = spark.read.text(path).select(F.col("day").cast("string").alias("day")).distinct().collect()
    gone = sorted(r["day"] for r in listed if r["day"] < str(oldest))
    delete_paths(spark, [f"{path}/{folder_path(spark, [('day', d)])}" for d in gone])
    return gone
