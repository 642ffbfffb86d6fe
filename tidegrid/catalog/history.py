"""Run history, with the events table read as a run log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidegrid.catalog.base import Registry, readings, round_all, sql_r6, table
from tidegrid.plans import history as H
from tidegrid.session import scratch_path
from tidegrid.sinks.stage import write_stage
from tidegrid.sources.events import read_run_events

QUERIES = Registry()

# A run is one user's day; its flow is the user; purchases are successes.
LOG = """log AS (SELECT ts, 'f' || user_id AS flow, 'f' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' ELSE 'start' END AS status, value AS duration_ms FROM events)"""
RUNS = f"""{LOG}, steps AS (SELECT DISTINCT flow, CAST(length(flow) - 2 AS BIGINT) AS n_steps FROM log WHERE flow NOT LIKE '%7'),
  tally AS (SELECT run_id, flow, min(ts) AS ts_start, max(ts) AS ts_end, count(*) FILTER (status = 'success') AS n_done,
    count(*) FILTER (status = 'error') AS n_failed FROM log GROUP BY ALL),
  runs AS (SELECT run_id, flow, CASE WHEN n_failed > 0 THEN 'error' WHEN coalesce(n_steps, 0) > 0 AND n_done >= n_steps THEN 'success'
      ELSE 'running' END AS status, ts_start, ts_end, coalesce(n_steps, 0) AS n_steps, n_done, n_failed
    FROM tally LEFT JOIN steps USING (flow))"""


def run_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    flow = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        flow.alias("flow"),
        F.concat(flow, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.when(kind == "error", "error").when(kind == "purchase", "success").otherwise("start").alias("status"),
        F.col("value").alias("duration_ms"),
    )


def flow_steps(log):
    flows = log.select("flow").distinct().filter(~F.col("flow").endswith("7"))
    return flows.withColumn("n_steps", (F.length("flow") - 2).cast("long"))


@QUERIES.add(f"WITH {LOG} SELECT * FROM log WHERE flow = 'f42' AND run_id = 'f42-20240115' OR run_id = 'f7-20240103'")
def run_events(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return H.events_for_run(log, "f42-20240115", "f42").unionByName(H.events_for_run(log, "f7-20240103"))


@QUERIES.add(f"WITH {RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY flow ORDER BY ts_start DESC, run_id DESC) = 1")
def latest_run(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return H.latest_run_per_flow(H.run_summaries(log, flow_steps(log)))


@QUERIES.add(f"WITH {RUNS} SELECT * FROM runs")
def run_status(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return H.run_summaries(log, flow_steps(log))


@QUERIES.add(
    f"""WITH {RUNS}, marked AS (SELECT *, CASE WHEN event_type = 'error' THEN 'broke at ' || event_id END AS error,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'skip' ELSE 'start' END AS state,
        'f' || user_id AS flow, 'f' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id FROM events),
      o AS (SELECT run_id, flow, min(ts) AS ts_start, max(ts) AS ts_end, count(*) FILTER (state IN ('success', 'skip')) AS n_done,
        count(*) FILTER (state = 'error') AS n_failed, {sql_r6("sum(value) FILTER (state <> 'start')")} AS duration_ms,
        arg_min(event_type, ts) FILTER (state = 'error') AS failed_step, arg_min(error, ts) FILTER (state = 'error') AS error FROM marked GROUP BY ALL)
    SELECT run_id, flow, CASE WHEN n_failed > 0 THEN 'error' WHEN coalesce(n_steps, 0) > 0 AND n_done >= n_steps THEN 'success'
      ELSE 'running' END AS status, ts_start, ts_end, coalesce(n_steps, 0) AS n_steps, n_done, n_failed, duration_ms, failed_step, error
    FROM o LEFT JOIN steps USING (flow)"""
)
def run_outcomes(spark, sf_dir):
    """Skipped steps count as done; time taken and first error of every run."""
    log = run_log(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    marked = e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("flow"),
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.when(kind == "error", "error").when(kind == "purchase", "success").when(kind == "view", "skip").otherwise("start").alias("status"),
        kind.alias("treatment"),
        F.col("value").alias("duration_ms"),
        F.when(kind == "error", F.concat(F.lit("broke at "), F.col("event_id").cast("string"))).alias("error"),
    )
    return round_all(H.run_outcomes(marked, flow_steps(log)))


@QUERIES.add(f"WITH {RUNS} SELECT * FROM runs ORDER BY ts_start DESC, run_id DESC LIMIT 50")
def recent_runs(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return H.recent_runs(H.run_summaries(log, flow_steps(log)), 50)


@QUERIES.add(f"WITH {LOG} SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-11 12:00:00'")
def prune_events(spark, sf_dir):
    now = datetime(2024, 1, 21, 12, tzinfo=timezone.utc)
    return H.prune_events(run_log(spark, sf_dir), now, days=10)


@QUERIES.add(f"WITH {LOG} SELECT * FROM log WHERE CAST(ts AS DATE) >= DATE '2024-01-11'")
def events_deleted(spark, sf_dir):
    """A log in folders per day, those older than ten days deleted; what is left, read back."""
    path = scratch_path(spark, "log")
    log = run_log(spark, sf_dir)
    dated = log.withColumn("day", F.to_date("ts"))
    dated.write.partitionBy("day").option("timestampFormat", H.EVENT_TIME).json(path)
    gone = H.delete_events(spark, path, datetime(2024, 1, 21, 12, tzinfo=timezone.utc), days=10)
    assert gone and max(gone) < "2024-01-11"
    return read_run_events(spark, path).select(log.columns)


@QUERIES.add(
    """SELECT ts, 'clean' AS treatment, event_type AS status, CAST(user_id AS VARCHAR) AS run_id, value AS duration_ms,
      CAST(event_id AS VARCHAR) AS id, '***' AS password FROM events WHERE event_id % 5 <> 3"""
)
def run_log_scan(spark, sf_dir):
    """Logs with broken and blank lines between the intact ones; secrets masked."""
    e = table(spark, sf_dir, "events")
    intact = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            F.lit("clean").alias("treatment"),
            F.col("event_type").alias("status"),
            F.col("user_id").cast("string").alias("run_id"),
            F.create_map(
                F.lit("id"), F.col("event_id").cast("string"), F.lit("password"), F.lit("hunter2")
            ).alias("params"),
            F.col("value").alias("duration_ms"),
        )
    )
    broken = F.when(F.col("event_id") % 10 == 3, F.substr(intact, F.lit(1), F.lit(40))).otherwise("")
    path = scratch_path(spark, "log")
    e.select(F.when(F.col("event_id") % 5 == 3, broken).otherwise(intact).alias("value")).write.text(path)
    back = H.mask_secrets(read_run_events(spark, path))
    return back.select(
        "ts", "treatment", "status", "run_id", "duration_ms",
        F.col("params")["id"].alias("id"), F.col("params")["password"].alias("password"),
    )


@QUERIES.add(
    """SELECT '10_parsed' AS stage, (SELECT count(*) FROM events) > 0 AS has_output, false AS external, 'up-to-date' AS dataset_status
    UNION ALL SELECT '20_clean', (SELECT count(*) FROM events WHERE value > 5) > 0, false, 'up-to-date'
    UNION ALL SELECT '60_database', false, true, 'up-to-date'"""
)
def stage_status(spark, sf_dir):
    """Whether two stages written from the readings have output, and one that is kept elsewhere."""
    df = readings(spark, sf_dir)
    root = scratch_path(spark, "dataset")
    write_stage(df, f"{root}/10_parsed")
    write_stage(df.filter("m0 > 5"), f"{root}/20_clean")
    stages = {n: f"{root}/{n}" for n in ("10_parsed", "20_clean", "60_database")}
    status = H.stage_status(spark, stages, external=["60_database"])
    # How many files there are, and when they were written, differs from run to run.
    return status.select("stage", (F.col("n_files") > 0).alias("has_output"), "external", "dataset_status")
