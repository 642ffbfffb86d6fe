"""Combining tables: merges by time, wide pivot, device dimension, range replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import names
from tidegrid.keys import KEYS, SEQ, TS, broadcast_if_small, data_columns


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per ``by`` in ``order``; copies are trimmed before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def merge_append(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    seq: str = SEQ,
    prefer: str = "existing",
) -> DataFrame:
    """Add rows to existing keys; where a timestamp repeats, the ``prefer`` side wins."""
    if prefer not in ("existing", "new"):
        raise ValueError(f"prefer must be 'existing' or 'new', not {prefer!r}")
    first = prefer == "existing"
    both = existing.withColumn("_age", F.lit(0 if first else 1)).unionByName(
        new.withColumn("_age", F.lit(1 if first else 0)), allowMissingColumns=True
    )
    order = ["_age", seq] if seq in both.columns else ["_age"]
    return first_per(both, [*keys, ts], order).drop("_age")


def merge_replace_window(
    existing: DataFrame,
    new: DataFrame,
    start=None,
    end=None,
    *,
    ts: str = TS,
    by: Sequence[str] = ("device_id",),
) -> DataFrame:
    """Existing rows outside ``[start, end)``, one per time, plus the new rows.

    Without a window the new rows replace everything. ``ts`` may be a local
    wall-clock column; the bounds are then given in the same clock.
    """
    if start is None and end is None:
        return new
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(ts) >= start)
    if end is not None:
        inside = inside & (F.col(ts) < end)
    kept = existing.filter(~inside)
    kept = first_per(kept, [*by, ts], [c for c in kept.columns if c not in (*by, ts)] or [ts])
    return kept.unionByName(new, allowMissingColumns=True)


def replace_range(existing: DataFrame, batch: DataFrame, ts: str = TS, day: str = "day") -> DataFrame:
    """Per day, rows between the batch's first and last timestamp give way to the batch."""
    ranges = batch.groupBy(day).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    kept = (
        existing.join(broadcast_if_small(ranges), day, "left")
        .filter(F.col("_from").isNull() | ~F.col(ts).between(F.col("_from"), F.col("_to")))
        .drop("_from", "_to")
    )
    return kept.unionByName(batch, allowMissingColumns=True)


def union_devices(tables: Mapping[str, DataFrame], ts: str = TS) -> DataFrame:
    """Stack per-device tables: union of columns, missing ones null, ``device_id`` added."""
    stacked = None
    for device, table in sorted(tables.items()):
        table = table.withColumn("device_id", F.lit(device))
        stacked = table if stacked is None else stacked.unionByName(table, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no device to stack")
    rest = [c for c in stacked.columns if c not in (ts, "device_id")]
    return stacked.select(ts, "device_id", *rest)


def concat_days(df: DataFrame, by: Sequence[str] = ("device_id",), ts: str = TS) -> DataFrame:
    """All days of each device in time order, range-partitioned so that a big
    device spans several tasks."""
    return df.repartitionByRange(*by, ts).sortWithinPartitions(*by, ts)


def pivot_wide(
    df: DataFrame,
    devices: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    *,
    by: Sequence[str] = (TS,),
) -> DataFrame:
    """One row per timestamp; columns ``device__column`` for every device and column.

    One grouped aggregate instead of an outer join per device. The device list
    names the output columns; without it the distinct devices are read.
    Sources must own their columns: two values for one cell raise.
    """
    columns = data_columns(df) if columns is None else list(columns)
    if devices is None:
        bound = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        listed = df.select("device_id").distinct().limit(bound + 1).collect()
        if len(listed) > bound:
            raise ValueError(f"more than {bound} devices: pass the list, or raise spark.sql.pivotMaxValues")
        devices = sorted(r["device_id"] for r in listed)
    prefix = {d: names.sanitize(d) for d in devices}
    if len(set(prefix.values())) < len(prefix):
        raise ValueError("two devices share a sanitised name")
    def checked(c: str) -> Column:
        low, high = F.min(c), F.max(c)
        place = F.concat_ws(" ", F.lit(f"two values for {c} of"), F.col("device_id"), *[F.col(b).cast("string") for b in by])
        clash = F.raise_error(place).cast(df.schema[c].dataType)
        return F.when(low.isNull() | (low == high), low).otherwise(clash).alias(c)

    # One row per time and device first; the pivot then places each row's
    # values by device instead of testing every device for every row.
    per_device = (
        df.filter(F.col("device_id").isin(list(devices)))
        .groupBy(*by, "device_id")
        .agg(*[checked(c) for c in columns])
    )
    wide = per_device.groupBy(*by).pivot("device_id", list(devices)).agg(*[F.first(c).alias(c) for c in columns])
    return wide.toDF(*by, *[f"{prefix[d]}__{c}" for d in devices for c in columns])


def upsert_devices(
    existing: DataFrame,
    new: DataFrame,
    key: str = "device_id",
    columns: Sequence[str] = ("name", "location", "type", "notes"),
) -> DataFrame:
    """Device dimension: insert or update; a new non-null value wins, others stay."""
    e, n = existing.alias("e"), new.alias("n")
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"e.{key}")).alias(key),
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"e.{c}")).alias(c) for c in columns],
    )


def device_rows(df: DataFrame, metadata: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """One dimension row per device seen in ``df``, described by ``metadata`` where given."""
    fields = ("name", "location", "type", "notes")
    seen = df.select("device_id").distinct()
    out = {}
    for field in fields:
        value = None
        for device, meta in (metadata or {}).items():
            if meta.get(field) is not None:
                test = F.col("device_id") == device
                value = F.when(test, F.lit(meta[field])) if value is None else value.when(test, F.lit(meta[field]))
        out[field] = F.lit(None).cast("string") if value is None else value
    return seen.select("device_id", *[v.alias(f) for f, v in out.items()])
