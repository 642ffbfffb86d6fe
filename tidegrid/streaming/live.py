"""Structured Streaming: parse, dedup, tumble and merge as rows arrive.

The watermark drops rows later than its bound; ``late_to_table`` keeps them, and the nightly
batch re-run of the window picks them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.functions.names import metric_name
from tidegrid.functions.scalars import bucket_start, micros_of
from tidegrid.keys import DAY_MICROS, KEYS, TS, data_columns
from tidegrid.operators.aggregate import DEFAULT_METRICS, reducer
from tidegrid.sinks.batches import append_batch, batch_facts, compact, read_all, read_batches
from tidegrid.sources.raw import parse_kv_lines, source_metadata, type_domains

# Fixed value: how late a row may come, as in the hourly two-hour re-run.
LATENESS = "2 hours"
DEVICE = ("experience", "device_id", "domain")
# Micro-batches between two compactions.
COMPACT_EVERY = 60


def stream_parse(
    lines: DataFrame,
    domains: Mapping[str, Mapping],
    keys: Sequence[str],
    *,
    delimiter: str = ";",
    tz: str = "UTC",
    substitutions: Sequence[Mapping[str, str]] = (),
) -> dict[str, DataFrame]:
    """The batch parse on a stream. The keys are declared: a stream cannot be scanned for them."""
    named = source_metadata(lines, substitutions=substitutions)
    return type_domains(parse_kv_lines(named, delimiter, tz=tz), domains, keys)


def stream_dedup(
    df: DataFrame,
    by: Sequence[str] = ("experience", "device_id", "domain", TS),
    ts: str = TS,
    lateness: str = LATENESS,
) -> DataFrame:
    """First arrival per key and timestamp within the lateness bound."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(by))


def bucket_label(window: str) -> str:
    """The window as Spark counts it; only windows that divide a day begin at midnight."""
    micros = micros_of(window)
    if DAY_MICROS % micros:
        raise ValueError(f"window {window!r} does not divide a day")
    return f"{micros} microseconds"


def stream_tumble(
    df: DataFrame,
    window: str,
    metrics: Sequence[str] = DEFAULT_METRICS,
    *,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = DEVICE,
    ts: str = TS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Tumbling metrics. In append mode a bucket comes out once it can no longer change, in
    update mode after every batch that changed it (see ``tumble_to_table``).

    Windows must divide a day. State is one row of partial aggregates per open
    bucket, combined map-side.
    """
    columns = data_columns(df) if columns is None else list(columns)
    bucket = F.window(ts, bucket_label(window))
    seen = df.withWatermark(ts, lateness)
    metrics_of = [
        reducer(m)(F.col(c), F.col(ts)).alias(metric_name(c, m)) for c in columns for m in metrics
    ]
    out = seen.groupBy(*keys, bucket.alias("_w")).agg(*metrics_of)
    return out.select(*keys, F.col("_w.start").alias(ts), *[metric_name(c, m) for c in columns for m in metrics])


def _to_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, once: bool, interval: str
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def _stream_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint, which numbers its batches."""
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:12]


def tumble_to_table(
    df: DataFrame,
    window: str,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = DEVICE,
    ts: str = TS,
    once: bool = True,
    interval: str = "1 minute",
    compact_every: int = COMPACT_EVERY,
    **options,
) -> StreamingQuery:
    """Tumbling metrics with the buckets still open, as a table of ``read_tumbled``.

    Every micro-batch adds the buckets it changed; the newest state of a bucket counts. At
    the end of the input no bucket is missing, and rows too late are all that is left out.
    """
    name = _stream_name(checkpoint)

    def add(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        if append_batch(batch, path, name, epoch) and (epoch + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys, ts, "new")

    return _to_batches(stream_tumble(df, window, keys=keys, ts=ts, **options), add, checkpoint, "update", once, interval)


def read_tumbled(spark: SparkSession, path: str, keys: Sequence[str] = DEVICE, ts: str = TS) -> DataFrame | None:
    return read_batches(spark, path, keys, ts, "new")


def late_to_table(
    df: DataFrame,
    window: str,
    path: str,
    checkpoint: str,
    *,
    ts: str = TS,
    lateness: str = LATENESS,
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """The rows that ``stream_tumble`` leaves out, as a table of ``read_late``.

    A row is too late if its bucket ended at or before the watermark of the batches before
    its own: their greatest time less ``lateness``, kept with each batch's commit.
    """
    name, micros, allowed = _stream_name(checkpoint), micros_of(window), lateness_micros(lateness)

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = max((int(f["newest"]) for f in batch_facts(spark, path) if "newest" in f), default=None)
        newest = batch.agg(F.max(F.unix_micros(ts))).first()[0]
        ends = F.unix_micros(bucket_start(F.col(ts), micros)) + micros
        late = batch.filter(F.lit(False) if before is None else ends <= before - allowed)
        known = [n for n in (before, newest) if n is not None]
        append_batch(late, path, name, epoch, {"newest": str(max(known))} if known else {})

    return _to_batches(df, add, checkpoint, "append", once, interval)


def lateness_micros(lateness: str) -> int:
    """Length of an interval such as ``2 hours`` or of a window label."""
    number, _, unit = lateness.partition(" ")
    if not unit:
        return micros_of(lateness)
    return int(number) * micros_of({"second": "1s", "minute": "1min", "hour": "1h", "day": "1d"}[unit.rstrip("s")])


def read_late(spark: SparkSession, path: str) -> DataFrame | None:
    return read_all(spark, path)


def stream_upsert(
    df: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = KEYS,
    once: bool = True,
    interval: str = "1 minute",
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Adds every micro-batch to a table that ``read_upserts`` merges, rows already there winning.

    A micro-batch writes its own rows only; a retried one writes nothing. Every
    ``compact_every`` batches the table is folded into one base.
    """
    name = _stream_name(checkpoint)

    def merge(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        if append_batch(batch, path, name, epoch) and (epoch + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys)

    return _to_batches(df, merge, checkpoint, "append", once, interval)


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame | None:
    return read_batches(spark, path, keys)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write everything available now to parquet files and stop."""
    return (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
