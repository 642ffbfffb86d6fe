"""Merges, exports, device dimension and the writers, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import (
    COARSE,
    K,
    READINGS,
    Registry,
    coarse,
    readings,
    round_all,
    sql_bucket,
    sql_r6,
    table,
)
from tidegrid.functions.scalars import local_time, moment
from tidegrid.operators import aggregate as A
from tidegrid.operators import columns as C
from tidegrid.operators import merge as M
from tidegrid.operators import normalize as N
from tidegrid.operators.clean import drop_duplicates
from tidegrid.session import scratch_path
from tidegrid.sinks import exports as X
from tidegrid.sinks.params import load_params, save_params
from tidegrid.sinks.stage import write_stage
from tidegrid.sinks.versions import drop_versions, write_version
from tidegrid.sources.stage import read_stage, read_typed
from tidegrid.sources.versions import read_version

QUERIES = Registry()

# --- aggregated tables used by the exports ---------------------------------------------


def two_domains(spark, sf_dir):
    """Readings as two domains: ``m0`` and ``m1`` of a device, and a temperature."""
    r = readings(spark, sf_dir)
    temps = r.select(
        "experience", "device_id", F.lit("environment").alias("domain"), "day", "ts", "seq",
        (F.col("m0") / 10).alias("outdoor_temp"),
    )
    return {"bio_signal": r, "environment": temps}


def aggregated(spark, sf_dir, windows=("1h", "6h")):
    """Both domains aggregated, as one table with the union of columns."""
    tables = {
        d: A.multi_window(t, list(windows), ["mean", "max"], dense=False)
        for d, t in two_domains(spark, sf_dir).items()
    }
    return C.stack_domains(tables)


def _sql_aggregated() -> str:
    parts = []
    for label, seconds in (("1h", 3600), ("6h", 21600)):
        parts.append(
            f"""SELECT {K}, '{label}' AS "window", {sql_bucket('ts', seconds)} AS bucket, avg(m0) AS m0__raw__mean, max(m0) AS m0__raw__max,
              avg(m1) AS m1__raw__mean, max(m1) AS m1__raw__max, NULL::DOUBLE AS outdoor_temp__raw__mean, NULL::DOUBLE AS outdoor_temp__raw__max
              FROM readings GROUP BY ALL"""
        )
        parts.append(
            f"""SELECT experience, device_id, 'environment', "day", '{label}', {sql_bucket('ts', seconds)}, NULL::DOUBLE, NULL::DOUBLE,
              NULL::DOUBLE, NULL::BIGINT, avg(m0 / 10), max(m0 / 10) FROM readings GROUP BY ALL"""
        )
    return f"{READINGS}, aggregated AS ({' UNION ALL '.join(parts)})"


AGGREGATED = _sql_aggregated()

# --- merges --------------------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {COARSE}, b AS (SELECT *, 0 AS age FROM coarse WHERE device_id IN ('view', 'click')
      UNION ALL SELECT * REPLACE (CASE device_id WHEN 'error' THEN 'view' ELSE device_id END AS device_id), 1 AS age
      FROM coarse WHERE device_id NOT IN ('view', 'click'))
    SELECT * EXCLUDE (age) FROM b QUALIFY row_number() OVER (PARTITION BY {K}, ts ORDER BY age, seq) = 1"""
)
def merge_append(spark, sf_dir):
    """Rows of a second batch join keys that exist; existing timestamps win."""
    df = coarse(spark, sf_dir)
    first = F.col("device_id").isin("view", "click")
    moved = F.when(F.col("device_id") == "error", "view").otherwise(F.col("device_id"))
    return M.merge_append(df.filter(first), df.filter(~first).withColumn("device_id", moved))


@QUERIES.add(
    f"""WITH {COARSE}, o AS (SELECT device_id, ts, min(m0) AS m0, min(m1) AS m1 FROM coarse GROUP BY ALL)
    SELECT * FROM o WHERE NOT (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00')
    UNION ALL
    SELECT device_id, ts, m0 * 2, m1 FROM o WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00'"""
)
def merge_replace_window(spark, sf_dir):
    old = coarse(spark, sf_dir).groupBy("device_id", "ts").agg(F.min("m0").alias("m0"), F.min("m1").alias("m1"))
    start, end = "2024-01-10", "2024-01-12T06:00:00"
    new = C.range_filter(old, start, end).withColumn("m0", F.col("m0") * 2)
    return M.merge_replace_window(old, new, moment(start), moment(end))


@QUERIES.add(
    f"""WITH {READINGS}, batch AS (SELECT * REPLACE (-m0 AS m0) FROM readings WHERE hour(ts) BETWEEN 6 AND 8),
      r AS (SELECT "day", min(ts) AS a, max(ts) AS z FROM batch GROUP BY ALL)
    SELECT t.* FROM readings t LEFT JOIN r USING ("day") WHERE r.a IS NULL OR t.ts NOT BETWEEN r.a AND r.z
    UNION ALL SELECT * FROM batch"""
)
def replace_range(spark, sf_dir):
    df = readings(spark, sf_dir)
    batch = df.filter(F.hour("ts").between(6, 8)).withColumn("m0", -F.col("m0"))
    return M.replace_range(df, batch)


@QUERIES.add(
    """SELECT event_type AS device_id, ts, CASE WHEN event_type IN ('error', 'signup') THEN event_id END AS event_id,
      CASE WHEN event_type IN ('error', 'view', 'purchase') THEN value END AS value,
      CASE WHEN event_type IN ('view', 'signup') THEN user_id END AS user_id,
      CASE WHEN event_type IN ('click', 'purchase') THEN props END AS props FROM events"""
)
def union_devices(spark, sf_dir):
    """Devices with different sensors in one table."""
    e = table(spark, sf_dir, "events")

    def of(device, *cols):
        return e.filter(F.col("event_type") == device).select("ts", *cols)

    sensors = {
        "view": ("value", "user_id"), "error": ("event_id", "value"), "click": ("props",),
        "purchase": ("value", "props"), "signup": ("event_id", "user_id"),
    }
    return M.union_devices({device: of(device, *names) for device, names in sensors.items()})


@QUERIES.add(
    f"""WITH {READINGS}, d AS (SELECT device_id, ts, "domain", m0, NULL::DOUBLE AS outdoor_temp FROM readings
      UNION ALL SELECT device_id, ts, 'environment', CASE WHEN m1 < 50 THEN -1.0 END, m0 / 10 FROM readings)
    SELECT device_id, ts, coalesce(min(m0) FILTER ("domain" = 'bio_signal'), min(m0)) AS m0, {sql_r6('min(outdoor_temp)')} AS outdoor_temp
    FROM d GROUP BY ALL"""
)
def coalesce_rows(spark, sf_dir):
    """Two domains at one time become one row; the first domain's value wins."""
    r = readings(spark, sf_dir)
    by = ["device_id", "ts"]
    first = r.groupBy(*by).agg(F.min("m0").alias("m0")).withColumn("domain", F.lit("bio_signal"))
    second = r.groupBy(*by).agg(
        F.when(F.min("m1") < 50, -1.0).alias("m0"), F.min(F.col("m0") / 10).alias("outdoor_temp")
    ).withColumn("domain", F.lit("environment"))
    both = first.unionByName(second, allowMissingColumns=True)
    return round_all(A.coalesce_rows(both, by, domains=["bio_signal", "environment"]))


@QUERIES.add(
    """WITH o AS (SELECT s_name AS device_id, 'plain' AS name, CASE WHEN s_nationkey < 12 THEN 'nation ' || s_nationkey END AS location,
        'pump' AS type, CAST(NULL AS VARCHAR) AS notes FROM supplier WHERE s_acctbal < 5000),
      n AS (SELECT s_name AS device_id, CASE WHEN s_nationkey >= 12 THEN 'renamed' END AS name, CAST(NULL AS VARCHAR) AS location,
        'valve' AS type, 'checked' AS notes FROM supplier WHERE s_acctbal > 2000)
    SELECT coalesce(n.device_id, o.device_id) AS device_id, coalesce(n.name, o.name) AS name, coalesce(n.location, o.location) AS location,
      coalesce(n.type, o.type) AS type, coalesce(n.notes, o.notes) AS notes FROM o FULL JOIN n ON n.device_id = o.device_id"""
)
def upsert_devices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey")
    old = s.filter("s_acctbal < 5000").select(
        F.col("s_name").alias("device_id"),
        F.lit("plain").alias("name"),
        F.when(nation < 12, F.concat(F.lit("nation "), nation.cast("string"))).alias("location"),
        F.lit("pump").alias("type"),
        F.lit(None).cast("string").alias("notes"),
    )
    new = s.filter("s_acctbal > 2000").select(
        F.col("s_name").alias("device_id"),
        F.when(nation >= 12, "renamed").alias("name"),
        F.lit(None).cast("string").alias("location"),
        F.lit("valve").alias("type"),
        F.lit("checked").alias("notes"),
    )
    return M.upsert_devices(old, new)


# --- exports ---------------------------------------------------------------------------------

CSV_COLUMNS = {
    "m0__raw__mean": {"name": "c0", "dtype": "int"},
    "m0__raw__max": {"name": "c1", "decimals": 1},
    "absent": "c9",
    "m1__raw__max": "c2",
}
CSV_SQL = f"""SELECT device_id, strftime((bucket AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%Y-%m-%d %H:%M:%S') AS "Time",
      CAST(round_even(round_even(m0__raw__mean * 1000000.0, 0) / 1000000.0, 0) AS BIGINT) AS c0,
      round_even(m0__raw__max * 10.0, 0) / 10.0 AS c1, m1__raw__max AS c2
    FROM aggregated WHERE "window" = '1h' AND "domain" = 'bio_signal'
      AND bucket >= TIMESTAMP '2024-01-03 00:00:00' AND bucket < TIMESTAMP '2024-01-20 12:00:00'"""
CSV_RANGE = {"start": "2024-01-03", "end": "2024-01-20T12:00:00Z"}


@QUERIES.add(f"WITH {AGGREGATED} {CSV_SQL}")
def export_csv_rows(spark, sf_dir):
    """Local time, selection, renaming and half-even rounding of one window and domain."""
    df = round_all(aggregated(spark, sf_dir))
    return X.export_rows(df, CSV_COLUMNS, tz="Europe/Paris", window="1h", domain="bio_signal", **CSV_RANGE)


@QUERIES.add(f"WITH {AGGREGATED} {CSV_SQL}")
def sink_csv(spark, sf_dir):
    """Written as CSV, part of it exported again, read back."""
    df = round_all(aggregated(spark, sf_dir))
    path = scratch_path(spark, "csv")
    options = {"tz": "Europe/Paris", "window": "1h", "domain": "bio_signal"}
    X.export_csv(df, path, CSV_COLUMNS, **options, **CSV_RANGE)
    part = {"start": "2024-01-08T06:00:00", "end": "2024-01-09"}
    X.export_csv(df, path, CSV_COLUMNS, **options, **part, run_from=part["start"], run_to=part["end"])
    like = X.export_rows(df, CSV_COLUMNS, **options)
    return X.read_csv_export(spark, path, like, "1h")


@QUERIES.add(
    f"""WITH {AGGREGATED} SELECT device_id, bucket AS ts, {sql_r6('m0__raw__mean')} AS mean, m1__raw__max AS top
    FROM aggregated WHERE "window" = '6h' AND "domain" = 'bio_signal'"""
)
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    names = {"m0__raw__mean": "mean", "absent": "none", "m1__raw__max": "top"}
    X.export_parquet(aggregated(spark, sf_dir), path, names, window="6h", domain="bio_signal")
    return round_all(X.read_parquet_export(spark, path, "6h"))


LONG = """SELECT bucket AS ts, device_id, round_even(max(m0__raw__mean) * 1000000.0, 0) / 1000000.0 AS m0__raw__mean, max(m0__raw__max) AS m0__raw__max,
    round_even(max(m1__raw__mean) * 1000000.0, 0) / 1000000.0 AS m1__raw__mean, max(m1__raw__max) AS m1__raw__max,
    round_even(max(outdoor_temp__raw__mean) * 1000000.0, 0) / 1000000.0 AS outdoor_temp__raw__mean,
    round_even(max(outdoor_temp__raw__max) * 1000000.0, 0) / 1000000.0 AS outdoor_temp__raw__max
  FROM aggregated WHERE "window" = '{window}' {more} GROUP BY ALL"""


@QUERIES.add(
    f"""WITH {AGGREGATED} {LONG.format(window='1h', more="AND bucket >= TIMESTAMP '2024-01-05' AND bucket < TIMESTAMP '2024-01-25 18:00:00'")}"""
)
def export_long(spark, sf_dir):
    """One row per time and device over both domains, within a range."""
    return round_all(X.long_table(aggregated(spark, sf_dir), "1h", "2024-01-05", "2024-01-25T18:00:00Z"))


@QUERIES.add(
    f"""WITH {AGGREGATED} SELECT '1h' AS "window", * FROM ({LONG.format(window='1h', more='')})
    UNION ALL SELECT '6h', * FROM ({LONG.format(window='6h', more='')})"""
)
def sink_long(spark, sf_dir):
    """All long tables written with the device dimension, and all read back."""
    path = scratch_path(spark, "long")
    tables = X.export_long(
        aggregated(spark, sf_dir), path, ["1h", "6h", "2d"], metadata={"view": {"name": "viewer"}}
    )
    assert set(tables) == {"data_1h", "data_6h", "devices"}
    back = [
        spark.read.parquet(tables[f"data_{w}"]).withColumn("window", F.lit(w)) for w in ("1h", "6h")
    ]
    return round_all(back[0].unionByName(back[1]))


@QUERIES.add(
    """SELECT DISTINCT event_type AS device_id, CASE event_type WHEN 'view' THEN 'second' WHEN 'click' THEN 'clicker' END AS name,
      CASE event_type WHEN 'view' THEN 'hall' END AS location, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS notes FROM events"""
)
def sink_devices(spark, sf_dir):
    """The device table after two exports, the second with partly new metadata."""
    path = scratch_path(spark, "long")
    df = aggregated(spark, sf_dir, ("6h",))
    X.export_long(df, path, ["6h"], metadata={"view": {"name": "first", "location": "hall"}, "click": {"name": "clicker"}})
    tables = X.export_long(df, path, ["6h"], metadata={"view": {"name": "second"}})
    return spark.read.parquet(tables["devices"])


@QUERIES.add(
    f"""WITH {AGGREGATED}, o AS (SELECT device_id, "window", strftime((bucket AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%Y-%m-%d %H:%M:%S') AS "Time",
      m0__raw__max AS c0, m1__raw__max AS c1, bucket FROM aggregated WHERE "domain" = 'bio_signal')
    SELECT device_id, "window", "Time",
      CASE WHEN "window" = '1h' AND bucket >= TIMESTAMP '2024-01-10 03:00:00' AND bucket < TIMESTAMP '2024-01-11 12:00:00' THEN NULL ELSE c0 END AS c0,
      CASE WHEN "window" = '1h' AND bucket >= TIMESTAMP '2024-01-10 03:00:00' AND bucket < TIMESTAMP '2024-01-11 12:00:00' THEN -c1 ELSE c1 END AS c1
    FROM o WHERE NOT ("window" = '6h' AND device_id = 'view' AND bucket >= TIMESTAMP '2024-01-20')"""
)
def sink_csv_windows(spark, sf_dir):
    """Two windows side by side: one device exported anew, one time range anew without a column."""
    df = round_all(aggregated(spark, sf_dir))
    path, spec = scratch_path(spark, "csv"), {"m0__raw__max": "c0", "m1__raw__max": "c1"}
    options = {"tz": "Europe/Paris", "domain": "bio_signal"}
    for window in ("1h", "6h"):
        X.export_csv(df, path, spec, window=window, **options)
    view = df.filter("device_id = 'view' AND ts < TIMESTAMP '2024-01-20'")
    X.export_csv(view, path, spec, window="6h", **options)
    part = {"start": "2024-01-10T03:00:00Z", "end": "2024-01-11T12:00:00Z"}
    lacking = df.drop("m0__raw__max").withColumn("m1__raw__max", -F.col("m1__raw__max"))
    X.export_csv(lacking, path, spec, window="1h", run_from=part["start"], run_to=part["end"], **part, **options)
    like = X.export_rows(df, spec, **options)
    back = [X.read_csv_export(spark, path, like, w).withColumn("window", F.lit(w)) for w in ("1h", "6h")]
    return back[0].unionByName(back[1])


DEVICES = ("click", "error", "purchase", "signup", "view")


def _sql_wide(columns: dict[str, tuple[str, ...]], where: str) -> str:
    cells = [
        f"max(CASE WHEN device_id = '{d}' THEN {c} END) AS {d}__{c}" for d, cols in columns.items() for c in cols
    ]
    rounded = [f"round_even({c.split(' AS ')[0]} * 1000000.0, 0) / 1000000.0 AS {c.split(' AS ')[1]}" if "mean" in c or "temp" in c else c for c in cells]
    return f'SELECT "day", bucket AS ts, {", ".join(rounded)} FROM aggregated WHERE {where} GROUP BY ALL'


@QUERIES.add(
    "WITH " + AGGREGATED + " " + _sql_wide(dict.fromkeys(DEVICES, ("m0__raw__mean", "m0__raw__max", "m1__raw__mean", "m1__raw__max", "outdoor_temp__raw__mean", "outdoor_temp__raw__max")), "\"window\" = '1h'")
)
def pivot_wide(spark, sf_dir):
    """One row per hour, a column per device and sensor, devices read from the data."""
    df = aggregated(spark, sf_dir).filter(F.col("window") == "1h")
    return round_all(M.pivot_wide(df, by=("day", "ts")))


SOURCES = [
    {"domain": "bio_signal", "devices": ["view"], "sensors": ["m*"], "metrics": ["max"]},
    {"domain": "bio_signal", "sensors": ["m0"], "transforms": ["raw"], "metrics": ["mean", "max"]},
    {"domain": "environment", "devices": ["error"], "columns": ["outdoor_temp__raw__mean"]},
]


@QUERIES.add(
    f"""WITH {AGGREGATED}
    SELECT {K}, "window", bucket AS ts, CASE WHEN "domain" = 'bio_signal' AND device_id <> 'view' THEN {sql_r6('m0__raw__mean')} END AS m0__raw__mean,
      CASE WHEN "domain" = 'bio_signal' THEN m0__raw__max END AS m0__raw__max, CASE WHEN "domain" = 'bio_signal' AND device_id = 'view' THEN m1__raw__max END AS m1__raw__max,
      CASE WHEN "domain" = 'environment' THEN {sql_r6('outdoor_temp__raw__mean')} END AS outdoor_temp__raw__mean
    FROM aggregated WHERE "domain" = 'bio_signal' OR device_id = 'error'"""
)
def select_structured(spark, sf_dir):
    """Wildcard lists per source entry, the first entry covering a row deciding."""
    return round_all(C.select_source(aggregated(spark, sf_dir), SOURCES))


@QUERIES.add(
    "WITH " + AGGREGATED + " " + _sql_wide(dict.fromkeys(DEVICES, ("m0__raw__mean",)), "\"window\" = '6h' AND \"domain\" = 'bio_signal'")
)
def sink_wide(spark, sf_dir):
    """Two exports of one wide table, the second replacing some days; read back."""
    df = aggregated(spark, sf_dir, ("6h",))
    path, spec = scratch_path(spark, "wide"), [{"domain": "bio_signal", "columns": ["m0__raw__mean"]}]
    first = df.withColumn("m0__raw__mean", F.when(F.day("day") % 3 == 0, -1.0).otherwise(F.col("m0__raw__mean")))
    X.export_wide(first, path, spec, devices=DEVICES)
    again = df.filter(F.day("day") % 3 == 0)
    tables = X.export_wide(again, path, spec, devices=DEVICES)
    return round_all(spark.read.parquet(tables["EVT__AGGREGATED__6H"]))


@QUERIES.add(
    "WITH " + AGGREGATED + " " + _sql_wide(dict.fromkeys(DEVICES, ("m0__raw__max",)), "\"window\" = '6h' AND \"domain\" = 'bio_signal'")
)
def sink_wide_append(spark, sf_dir):
    """Appended twice: one row per time, values that are there stay, other devices' come in."""
    df = aggregated(spark, sf_dir, ("6h",))
    path, spec = scratch_path(spark, "wide"), [{"domain": "bio_signal", "columns": ["m0__raw__max"]}]
    first = df.filter(F.col("device_id").isin("view", "click") & (F.day("day") < 20))
    X.export_wide(first, path, spec, devices=DEVICES)
    known = F.col("device_id").isin("view", "click") & (F.day("day") < 20)
    again = df.withColumn("m0__raw__max", F.when(known, -1.0).otherwise(F.col("m0__raw__max")))
    tables = X.export_wide(again, path, spec, devices=DEVICES, mode="append")
    return round_all(read_typed(spark, tables["EVT__AGGREGATED__6H"]))


# --- stage tables ------------------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12' THEN -m0 ELSE m0 END AS m0)
    FROM readings WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'"""
)
def sink_stage(spark, sf_dir):
    """Written, a window of it replaced, the rest of the touched days kept; pruned on reading."""
    df = readings(spark, sf_dir)
    path = scratch_path(spark, "stage-table")
    write_stage(df, path)
    start, end = "2024-01-10T06:00:00Z", "2024-01-12T00:00:00Z"
    again = C.range_filter(df, start, end).withColumn("m0", -F.col("m0"))
    write_stage(again, path, "replace", start, end)
    back = read_stage(spark, path, "2024-01-02", "2024-01-28", domain="bio_signal")
    return back.select(df.columns)


# Every third reading has no window, every fifth none of domain or day.
NULL_LABELS = f"""{READINGS}, labelled AS (SELECT * REPLACE (CASE WHEN seq % 5 > 0 THEN "domain" END AS "domain", CASE WHEN seq % 5 > 0 THEN "day" END AS "day"),
    CASE WHEN seq % 3 > 0 THEN '1h' END AS "window" FROM readings)"""


def null_labels(spark, sf_dir):
    rest = F.col("seq") % 5 > 0
    return readings(spark, sf_dir).withColumns(
        {"domain": F.when(rest, F.col("domain")), "day": F.when(rest, F.col("day")), "window": F.when(F.col("seq") % 3 > 0, "1h")}
    )


@QUERIES.add(
    f"""WITH {NULL_LABELS} SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12' AND "day" IS NOT NULL
      THEN -m0 ELSE m0 END AS m0) FROM labelled UNION ALL SELECT * REPLACE (TIMESTAMP '2030-01-01' + INTERVAL 1 SECOND * seq AS ts) FROM labelled WHERE seq % 15 = 0"""
)
def sink_stage_null_window(spark, sf_dir):
    """A stage with null windows, domains and days: a window replaced, then rows appended to null labels."""
    df = null_labels(spark, sf_dir)
    path = scratch_path(spark, "null-labels")
    write_stage(df, path)
    start, end = "2024-01-10T06:00:00Z", "2024-01-12T00:00:00Z"
    inside = C.range_filter(df, start, end).filter("day IS NOT NULL")
    write_stage(inside.withColumn("m0", -F.col("m0")), path, "replace", start, end)
    later = df.filter("seq % 15 = 0").withColumn(
        "ts", F.timestamp_micros(F.unix_micros(F.lit("2030-01-01T00:00:00Z").cast("timestamp")) + F.col("seq") * 1_000_000)
    )
    write_stage(later, path, "append")
    return read_typed(spark, path).select(df.columns)


@QUERIES.add(
    f"""WITH {NULL_LABELS} SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12' AND "day" IS NOT NULL
      THEN -m0 ELSE m0 END AS m0) FROM labelled UNION ALL SELECT * REPLACE (TIMESTAMP '2030-01-01' + INTERVAL 1 SECOND * seq AS ts) FROM labelled WHERE seq % 15 = 0"""
)
def sink_versions(spark, sf_dir):
    """The same as versions of a table, of which only the last is kept."""
    df = null_labels(spark, sf_dir)
    path = scratch_path(spark, "versions")
    write_version(df, path)
    start, end = "2024-01-10T06:00:00Z", "2024-01-12T00:00:00Z"
    inside = C.range_filter(df, start, end).filter("day IS NOT NULL")
    write_version(inside.withColumn("m0", -F.col("m0")), path, "replace", start, end)
    later = df.filter("seq % 15 = 0").withColumn(
        "ts", F.timestamp_micros(F.unix_micros(F.lit("2030-01-01T00:00:00Z").cast("timestamp")) + F.col("seq") * 1_000_000)
    )
    write_version(later, path, "append")
    drop_versions(spark, path, keep=1)
    return read_version(spark, path).select(df.columns)


@QUERIES.add(
    f"""WITH {COARSE}, b AS (SELECT *, 0 AS age FROM coarse WHERE m0 >= 20 UNION ALL SELECT *, 1 FROM coarse)
    SELECT * EXCLUDE (age) FROM b QUALIFY row_number() OVER (PARTITION BY {K}, ts ORDER BY age, seq) = 1"""
)
def sink_append(spark, sf_dir):
    """Appending to existing days: new timestamps come in once, existing rows stay."""
    df = coarse(spark, sf_dir)
    path = scratch_path(spark, "stage-table")
    write_stage(df.filter("m0 >= 20"), path)
    write_stage(df, path, "append")
    return read_stage(spark, path).select(df.columns)


LABELS = """SELECT experience, CASE device_id WHEN 'view' THEN '007' ELSE device_id END AS device_id, '0' || (m1 % 3) AS "domain",
      '1d' AS "window", "day", ts, seq, m0 FROM readings"""


@QUERIES.add(
    f"""WITH {READINGS}, labelled AS ({LABELS})
    SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12' THEN -m0 ELSE m0 END AS m0) FROM labelled"""
)
def sink_stage_labels(spark, sf_dir):
    """Labels that look like numbers stay text, also where a window is replaced."""
    df = readings(spark, sf_dir).select(
        "experience",
        F.when(F.col("device_id") == "view", "007").otherwise(F.col("device_id")).alias("device_id"),
        F.concat(F.lit("0"), (F.col("m1") % 3).cast("string")).alias("domain"),
        F.lit("1d").alias("window"),
        "day", "ts", "seq", "m0",
    )
    path = scratch_path(spark, "stage-table")
    write_stage(df, path)
    start, end = "2024-01-10T06:00:00Z", "2024-01-12T00:00:00Z"
    write_stage(C.range_filter(df, start, end).withColumn("m0", -F.col("m0")), path, "replace", start, end)
    return read_stage(spark, path).select(df.columns)


@QUERIES.add(
    f"""WITH {READINGS} SELECT {K}, '1h' AS "window", {sql_bucket('ts', 3600)} AS ts, {sql_r6('avg(m0)')} AS m0__raw__mean,
      count(m0) AS m0__raw__count FROM readings GROUP BY ALL"""
)
def sink_append_aggregates(spark, sf_dir):
    """Hourly results appended after each of two batches: late rows change their hour."""
    df = readings(spark, sf_dir).drop("m1")
    path = scratch_path(spark, "stage-table")
    for batch in (df.filter("m0 >= 20"), df):
        hourly = A.multi_window(batch, ["1h"], ["mean", "count"], dense=False)
        write_stage(hourly, path, "append", prefer="new")
    return round_all(read_stage(spark, path).select(hourly.columns))


@QUERIES.add(
    f"""WITH {READINGS}, n AS (SELECT * REPLACE (CASE WHEN m1 % 7 = 0 THEN NULL ELSE m0 END AS m0) FROM readings)
    SELECT {K}, {sql_bucket('ts', 21600)} AS ts, {sql_r6('avg(m0)')} AS m0__raw__mean, max(m0) AS m0__raw__max, count(m0) AS m0__raw__count
    FROM n GROUP BY ALL"""
)
def nan_values(spark, sf_dir):
    """NaN in a stored stage is no value: it enters neither means nor counts."""
    df = readings(spark, sf_dir)
    broken = df.withColumn("m0", F.when(F.col("m1") % 7 == 0, float("nan")).otherwise(F.col("m0"))).drop("m1")
    path = scratch_path(spark, "stage-table")
    write_stage(broken, path)
    stage = read_stage(spark, path)
    return round_all(A.tumble(stage, "6h", ["mean", "max", "count"], dense=False))


@QUERIES.add(
    f"""WITH {READINGS} SELECT experience, device_id, "column", {sql_r6('lo')} AS lo, {sql_r6('hi')} AS hi FROM (
      SELECT experience, device_id, 'm0' AS "column", quantile_cont(m0, 0.02) AS lo, quantile_cont(m0, 0.98) AS hi FROM readings GROUP BY ALL
      UNION ALL SELECT experience, device_id, 'm1', quantile_cont(CAST(m1 AS DOUBLE), 0.02), quantile_cont(CAST(m1 AS DOUBLE), 0.98) FROM readings GROUP BY ALL)"""
)
def sink_params(spark, sf_dir):
    """A fit saved, the stage replaced, the fit read back."""
    df = readings(spark, sf_dir)
    path = scratch_path(spark, "fit")
    save_params(N.fit(df), path, N.fit_meta(df, N.fit(df)))
    return load_params(spark, path)


# --- reports -------------------------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {COARSE}, deduped AS (SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY {K}, ts ORDER BY seq) = 1)
    SELECT device_id, "day", CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(clean) AS BIGINT) AS clean, CAST(sum(late) AS BIGINT) AS late FROM (
      SELECT device_id, "day", count(*) AS raw, NULL AS clean, NULL AS late FROM coarse GROUP BY ALL
      UNION ALL SELECT device_id, "day", NULL, count(*), NULL FROM deduped GROUP BY ALL
      UNION ALL SELECT device_id, "day", NULL, NULL, count(*) FROM coarse WHERE hour(ts) >= 20 GROUP BY ALL)
    WHERE "day" BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' AND device_id IN ('view', 'error') GROUP BY ALL"""
)
def row_counts(spark, sf_dir):
    df = coarse(spark, sf_dir)
    stages = {"raw": df, "clean": drop_duplicates(df), "late": df.filter(F.hour("ts") >= 20)}
    return A.row_counts(stages, "2024-01-03", "2024-01-27", ["view", "error"])


@QUERIES.add(
    f"""WITH {READINGS} SELECT device_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows,
      strftime((min(ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M:%S') AS first_local FROM readings GROUP BY ALL"""
)
def batch_span(spark, sf_dir):
    out = A.span(readings(spark, sf_dir), ["device_id"])
    return out.withColumn("first_local", local_time(F.col("first_ts"), "Asia/Tokyo"))


@QUERIES.add(f"WITH {READINGS} SELECT * FROM readings")
def concat_days(spark, sf_dir):
    """All days of every device, range-partitioned into time order."""
    return M.concat_days(readings(spark, sf_dir))
