"""Writing stage tables, with the output modes replace, reset and append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import moment, parse_iso_utc
from tidegrid.keys import KEYS, SEQ, TS, null_safe_join
from tidegrid.operators.columns import prune_days
from tidegrid.operators.merge import first_per, merge_append
from tidegrid.session import delete_paths, folder_path, staged
from tidegrid.sources.stage import read_typed

# Rows per output file; a bigger partition rolls over to the next file.
RECORDS_PER_FILE = 20_000_000


def _partitions(df: DataFrame) -> list[str]:
    return [c for c in ("domain", "window", "day") if c in df.columns]


def _write(df: DataFrame, path: str, mode: str, dynamic: bool, partitions: Sequence[str]) -> None:
    # REBALANCE gathers each output partition into few files and, under AQE,
    # splits the ones that are too big for one task.
    balanced = df.hint("rebalance", *partitions) if partitions else df.hint("rebalance")
    writer = (
        balanced.write.mode(mode)
        .partitionBy(*partitions)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
    )
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    writer.parquet(path)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_typed(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_stage(
    df: DataFrame,
    path: str,
    mode: str = "replace",
    start=None,
    end=None,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    prefer: str = "existing",
) -> None:
    """Write a stage table partitioned by domain, window and day.

    ``replace`` without a window rewrites the table; with ``[start, end)`` it
    replaces only those rows: rows of the touched days outside the window are
    kept. ``reset`` empties the table first. ``append`` merges into existing
    days, one row per key and timestamp: of equal timestamps the ``existing`` row stays,
    as for parsed lines, or with ``prefer="new"`` the new one, as for results that later
    rows change. A first append keeps one row per timestamp too, so that the number of
    batches does not show.
    """
    spark = df.sparkSession
    partitions = _partitions(df)
    if mode == "reset" or (mode == "replace" and start is None and end is None):
        _write(df, path, "overwrite", False, partitions)
        return
    existing = read_if_exists(spark, path)
    if mode == "append":
        by = [*keys, "window"] if "window" in partitions else list(keys)
        if existing is None:
            # Without an order of arrival, one that only the rows decide.
            order = [SEQ] if SEQ in df.columns else [F.xxhash64(*df.columns)]
            _write(first_per(df, [*by, ts], order), path, "append", False, partitions)
            return
        touched = df.select(*partitions).distinct()
        old = null_safe_join(existing, touched, partitions, "left_semi")
        result = merge_append(old, df, by, ts, prefer=prefer)
    elif mode == "replace":
        inside = F.lit(True)
        if start is not None:
            inside = inside & (F.col(ts) >= moment(start))
        if end is not None:
            inside = inside & (F.col(ts) < moment(end))
        result = df.filter(inside)
        if existing is not None:
            days = prune_days(existing, start, end)
            # Half-open: a window ending at midnight does not touch the next day.
            if end is not None and parse_iso_utc(end).time().isoformat() == "00:00:00":
                days = days.filter(F.col("day") < F.lit(parse_iso_utc(end).date()))
            outside = days.filter(~inside)
            emptied = days.select(*partitions).distinct()
            result = outside.unionByName(result, allowMissingColumns=True)
            _replace_partitions(spark, result, emptied, path, partitions)
            return
    else:
        raise ValueError(f"unknown output mode {mode!r}")
    # A table cannot be overwritten while it is read: stage the rows first.
    with staged(result, "stage") as rows:
        _write(rows, path, "overwrite", True, partitions)


def _replace_partitions(
    spark: SparkSession, rows: DataFrame, touched: DataFrame, path: str, partitions: Sequence[str]
) -> None:
    """Overwrite the partitions of ``rows``; touched ones left without rows are dropped."""
    with staged(rows, "stage") as kept, staged(touched, "touched") as before:
        if not kept.isEmpty():
            _write(kept, path, "overwrite", True, partitions)
        # One row per emptied partition: the list of folders to delete.
        filled = kept.select(*partitions).distinct()
        gone = null_safe_join(before, filled, partitions, "left_anti").collect()
    folders = [[(p, row[p]) for p in partitions] for row in gone]
    delete_paths(spark, [f"{path}/{folder_path(spark, f)}" for f in folders])
