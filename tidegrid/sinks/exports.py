"""Exports: CSV and parquet per device, long tables per window, wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import names
from tidegrid.functions import scalars as S
from tidegrid.keys import TS, data_columns
from tidegrid.operators.aggregate import coalesce_rows, span
from tidegrid.operators.columns import (
    format_columns,
    range_filter,
    select_aggregation,
    select_rename,
    select_source,
)
from tidegrid.operators.merge import (
    device_rows,
    merge_replace_window,
    pivot_wide,
    replace_range,
    upsert_devices,
)
from tidegrid.session import cut_lineage, delete_paths, folder_path, staged
from tidegrid.sinks.stage import RECORDS_PER_FILE, read_if_exists
from tidegrid.sources.stage import read_typed

# Windows exported when none are named.
EXPORT_WINDOWS = ("10s", "60s", "5min", "1h")


# --- one folder per device ---------------------------------------------------


def export_rows(
    df: DataFrame,
    columns: Mapping[str, str | Mapping],
    *,
    tz: str = "UTC",
    start=None,
    end=None,
    window: str | None = None,
    domain: str | None = None,
    ts: str = TS,
) -> DataFrame:
    """Rows of the text export: ``device_id``, local ``Time``, then the declared columns."""
    picked = range_filter(select_aggregation(df, window, domain), start, end, ts)
    spec = {s: ({"name": v} if isinstance(v, str) else dict(v)) for s, v in columns.items()}
    present = {s: v for s, v in spec.items() if s in df.columns}
    if not present:
        raise ValueError(f"none of the requested columns exist: {sorted(spec)}")
    out = picked.select(
        "device_id",
        S.local_time(F.col(ts), tz).alias("Time"),
        *[F.col(s).alias(v["name"]) for s, v in present.items()],
    )
    return format_columns(out, {v["name"]: v for v in present.values()})


LOCAL_DAY = "local_day"


def export_folder(spark, path: str, window: str | None) -> str:
    """Where the export of one window lies: exports of other windows are never touched."""
    return f"{path}/{folder_path(spark, [('window', window)])}"


def _write_devices(rows: DataFrame, folders: Sequence[str], order: str):
    """Files in time order under ``device_id=…``; a big device spans several files.

    Only the folders that ``rows`` fill are replaced.
    """
    return (
        rows.repartitionByRange(*folders, order)
        .sortWithinPartitions(*folders, order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .partitionBy(*folders)
    )


def _header(spark, folder: str) -> list[str] | None:
    """Columns of an earlier export; all its files have the same."""
    try:
        found = spark.read.option("sep", ";").option("header", "true").csv(folder)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return [c for c in found.columns if c not in ("device_id", LOCAL_DAY)] or None


def _read_csv(spark, folder: str, header: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    fields = [f"`{c}` {types.get(c, 'string')}" for c in header]
    schema = ", ".join([*fields, "device_id string", f"{LOCAL_DAY} string"])
    return spark.read.schema(schema).option("sep", ";").option("header", "true").csv(folder)


def export_csv(
    df: DataFrame,
    path: str,
    columns: Mapping[str, str | Mapping],
    *,
    tz: str = "UTC",
    start=None,
    end=None,
    window: str | None = None,
    domain: str | None = None,
    run_from=None,
    run_to=None,
) -> DataFrame:
    """Write ``;``-separated files per window, device and local day; nulls are empty.

    An export replaces the earlier files of its own devices and window only. With a run
    window it replaces the rows of that window, compared in local time, and rewrites only
    the local days it touches. All files of a window have the same columns: one that a
    batch lacks stays, empty, and one that it brings is added to the earlier files.
    Returns first and last local date and row count per device.
    """
    spark = df.sparkSession
    rows = export_rows(df, columns, tz=tz, start=start, end=end, window=window, domain=domain)
    folder = export_folder(spark, path, window)
    day = F.substr("Time", F.lit(1), F.lit(10))
    types = dict(rows.dtypes)
    header = _header(spark, folder)
    partial = run_from is not None or run_to is not None
    gone: list[str] = []
    if header is not None:
        declared = [v if isinstance(v, str) else v["name"] for v in columns.values()]
        known = {*header, *rows.columns}
        names_ = [c for c in dict.fromkeys([*header[:1], *declared, *header]) if c in known and c != "device_id"]
        rows = rows.select(
            "device_id", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names_]
        )
        old = _read_csv(spark, folder, header, types)
        widened = set(names_) - set(header)
        if partial:
            wall = lambda t: None if t is None else S.local_time(S.moment(t), tz)
            low, high = wall(run_from), wall(run_to)
            touched = old
            if not widened:
                if low is not None:
                    touched = touched.filter(F.col(LOCAL_DAY) >= F.substr(low, F.lit(1), F.lit(10)))
                if high is not None:
                    touched = touched.filter(F.col(LOCAL_DAY) <= F.substr(high, F.lit(1), F.lit(10)))
            before = touched.select("device_id", LOCAL_DAY).distinct()
            rows = merge_replace_window(touched.drop(LOCAL_DAY), rows, low, high, ts="Time")
        else:
            if widened:
                others = old.join(rows.select("device_id").distinct(), "device_id", "left_anti")
                rows = rows.unionByName(others.drop(LOCAL_DAY), allowMissingColumns=True)
            before = old.join(rows.select("device_id").distinct(), "device_id", "left_semi")
            before = before.select("device_id", LOCAL_DAY).distinct()
        # A folder cannot be overwritten while it is read: compute the rows first.
        before = cut_lineage(before, "csv-before")
        rows = cut_lineage(rows, "csv")
        left = rows.select("device_id", day.alias(LOCAL_DAY)).distinct()
        # One row per device and day that has no rows any more: the folders to delete.
        emptied = before.join(left, ["device_id", LOCAL_DAY], "left_anti").collect()
        gone = [f"{folder}/{folder_path(spark, [(c, r[c]) for c in ('device_id', LOCAL_DAY)])}" for r in emptied]
    _write_devices(rows.withColumn(LOCAL_DAY, day), ("device_id", LOCAL_DAY), "Time").option("sep", ";").option(
        "header", "true"
    ).option("emptyValue", "").csv(folder)
    # Last: a write that fails leaves the earlier files.
    delete_paths(spark, gone)
    return rows.groupBy("device_id").agg(
        F.substr(F.min("Time"), F.lit(1), F.lit(10)).alias("first_date"),
        F.substr(F.max("Time"), F.lit(1), F.lit(10)).alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
    )


def read_csv_export(spark, path: str, like: DataFrame, window: str | None = None) -> DataFrame:
    """Read the export of a window back with the columns and types of ``like``, by name."""
    folder = export_folder(spark, path, window)
    back = _read_csv(spark, folder, _header(spark, folder) or [], dict(like.dtypes))
    return back.select(
        *[F.col(c) if c in back.columns else F.lit(None).cast(t).alias(c) for c, t in like.dtypes]
    )


def export_parquet(
    df: DataFrame,
    path: str,
    columns: Mapping[str, str] | None = None,
    *,
    window: str | None = None,
    domain: str | None = None,
    ts: str = TS,
) -> DataFrame:
    """Parquet per window and device with optional selection and renaming.

    Replaces the earlier files of its own devices and window only; returns the span per device.
    """
    picked = select_aggregation(df, window, domain)
    picked = picked.select(ts, "device_id", *data_columns(picked))
    rows = select_rename(picked, columns or {}, keep=(ts, "device_id"))
    _write_devices(rows, ("device_id",), ts).parquet(export_folder(df.sparkSession, path, window))
    return span(rows, ["device_id"], ts)


def read_parquet_export(spark, path: str, window: str | None = None) -> DataFrame:
    return read_typed(spark, export_folder(spark, path, window))


# --- long tables -------------------------------------------------------------


def long_table(
    df: DataFrame, window: str, start=None, end=None, domains: Sequence[str] | None = None, ts: str = TS
) -> DataFrame:
    """One row per (ts, device_id) of a window; a sensor a device lacks is null."""
    rows = range_filter(df.filter(F.col("window") == window), start, end, ts)
    columns = data_columns(rows)
    merged = coalesce_rows(rows, (ts, "device_id"), columns, domains)
    return merged.select(ts, "device_id", *columns)


def long_table_name(window: str) -> str:
    return f"data_{window.replace('-', '_')}"


def export_long(
    df: DataFrame,
    path: str,
    windows: Sequence[str] = EXPORT_WINDOWS,
    start=None,
    end=None,
    metadata: Mapping[str, Mapping[str, str]] | None = None,
    db_name: str | None = None,
    domains: Sequence[str] | None = None,
) -> dict[str, str]:
    """A table per window, fully replaced, and a ``devices`` table, updated.

    Windows without rows are skipped. Returns table name to path.
    """
    spark = df.sparkSession
    if not db_name:
        first = df.select(F.min("experience").alias("e")).first()
        db_name = (first["e"] or "dataset").lower() if first else "dataset"
    root = f"{path}/{db_name}"
    written = {}
    wanted = range_filter(df.filter(F.col("window").isin(list(windows))), start, end)
    # Read for every window and for the devices: what leads up to it is computed once.
    with staged(wanted, "long") as seen:
        filled = {r["window"] for r in seen.select("window").distinct().collect()}
        for window in [w for w in windows if w in filled]:
            table = long_table(seen, window, domains=domains)
            target = f"{root}/{long_table_name(window)}"
            table.repartitionByRange(TS, "device_id").sortWithinPartitions(TS, "device_id").write.mode(
                "overwrite"
            ).option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(target)
            written[long_table_name(window)] = target
        if written:
            fresh = device_rows(seen, metadata)
            old = read_if_exists(spark, f"{root}/devices")
            with staged(fresh if old is None else upsert_devices(old, fresh), "devices") as devices:
                devices.write.mode("overwrite").parquet(f"{root}/devices")
            written["devices"] = f"{root}/devices"
    return written


# --- wide tables -------------------------------------------------------------


def wide_table(
    df: DataFrame,
    sources: Sequence[Mapping],
    *,
    devices: Sequence[str] | None = None,
    window: str | None = None,
) -> DataFrame:
    """One row per timestamp, a column per device and selected sensor, with its day."""
    rows = select_source(select_aggregation(df, window), sources)
    return pivot_wide(rows, devices, by=("day", TS))


def export_wide(
    df: DataFrame,
    path: str,
    sources: Sequence[Mapping],
    *,
    template: str = "{experience}__{step}__{aggregation}",
    prefix: str = "",
    step: str = "aggregated",
    windows: Sequence[str] = (),
    devices: Sequence[str] | None = None,
    mode: str = "replace",
) -> dict[str, str]:
    """One wide table per experience and window, replaced range by range per day.

    Columns a later batch brings are added; ``append`` keeps the rows already
    there. Returns table name to path.
    """
    spark = df.sparkSession
    # One row per output table.
    listed = df.select("experience", "window").distinct().collect()
    tables = {}
    for row in sorted(listed, key=lambda r: (r["experience"], r["window"] or "")):
        if windows and row["window"] not in windows:
            continue
        name = names.table_name(
            prefix + template,
            {"experience": row["experience"], "step": step, "aggregation": row["window"]},
        )
        part = df.filter(
            (F.col("experience") == row["experience"]) & F.col("window").eqNullSafe(row["window"])
        )
        batch = wide_table(part, sources, devices=devices)
        target = f"{path}/{name}"
        old = read_if_exists(spark, target)
        if old is not None:
            days = batch.select("day").distinct()
            touched = old.join(days, "day", "left_semi")
            if mode == "append":
                batch = _one_row_per_time(touched, batch)
            else:
                batch = replace_range(touched, batch)
        with staged(batch, "wide") as ready:
            ready.hint("rebalance", "day").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("day").parquet(target)
        tables[name] = target
    return tables


def _one_row_per_time(old: DataFrame, new: DataFrame, by: Sequence[str] = ("day", TS)) -> DataFrame:
    """Both tables with one row per time; where both fill a cell the old value stays."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    cells = [c for c in both.columns if c not in (*by, "_age")]
    return both.groupBy(*by).agg(
        *[
            F.coalesce(*[F.max(F.when(F.col("_age") == age, F.col(f"`{c}`"))) for age in (0, 1)]).alias(c)
            for c in cells
        ]
    )


# Column types of a relational target.
DATABASE_TYPES = {
    "timestamp": "TIMESTAMPTZ",
    "timestamp_ntz": "TIMESTAMPTZ",
    "bigint": "BIGINT",
    "int": "BIGINT",
    "double": "DOUBLE PRECISION",
    "float": "DOUBLE PRECISION",
}


def database_type(spark_type: str) -> str:
    return DATABASE_TYPES.get(spark_type, "TEXT")


def write_database(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    """Append a wide table to a database over JDBC; the driver jar is the caller's.

    The range to replace is deleted by the caller beforehand, with the bounds
    ``span`` gives.
    """
    types = ", ".join(f"`{c}` {database_type(t)}" for c, t in df.dtypes)
    df.write.option("createTableColumnTypes", types).jdbc(url, table, "append", dict(properties))
