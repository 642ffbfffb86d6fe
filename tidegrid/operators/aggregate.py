"""Tumbling aggregation, one or several windows at once, with empty buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.names import metric_name
from tidegrid.functions.scalars import bucket_start, micros_of, round_even
from tidegrid.keys import KEYS, SEQ, TS, data_columns, needs_slices
from tidegrid.operators.quantiles import exact_quantiles

# Windows and metrics used when none are named.
DEFAULT_WINDOWS = ("1s", "10s", "60s", "5min", "1h")
DEFAULT_METRICS = ("mean", "std")


def _kept(col: Column, order: Column) -> Column:
    return F.when(col.isNotNull(), order)


# Each reducer skips nulls. The second argument is the row order, for first and last.
REDUCERS = {
    "mean": lambda c, o: F.avg(c),
    "std": lambda c, o: F.stddev_samp(c),
    "var": lambda c, o: F.var_samp(c),
    "sem": lambda c, o: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "sum": lambda c, o: F.coalesce(F.sum(c), F.lit(0)),
    "count": lambda c, o: F.count(c),
    "size": lambda c, o: F.count(F.lit(1)),
    "nunique": lambda c, o: F.count_distinct(c),
    "median": lambda c, o: F.percentile(c, 0.5),
    "first": lambda c, o: F.min_by(c, _kept(c, o)),
    "nearest": lambda c, o: F.min_by(c, _kept(c, o)),
    "last": lambda c, o: F.max_by(c, _kept(c, o)),
}
# Reducers that give 0, not null, for a bucket without rows.
ZERO_WHEN_EMPTY = frozenset(("sum", "count", "size", "nunique"))


def reducer(name: str):
    if name not in REDUCERS:
        raise ValueError(f"unknown metric {name!r}, known: {sorted(REDUCERS)}")
    return REDUCERS[name]


def _row_order(df: DataFrame, ts: str, metrics: Sequence[str]) -> Column:
    """Order for first and last: a plain timestamp unless rows may share one."""
    if SEQ in df.columns and {"first", "last", "nearest"} & set(metrics):
        return F.struct(ts, SEQ)
    return F.col(ts)


def _aggregate(
    df: DataFrame,
    group: Sequence[str],
    columns: Sequence[str],
    metrics: Sequence[str],
    order: Column,
    split: bool | None,
) -> DataFrame:
    """One grouped aggregate. Medians and distinct counts of a group too big for
    one task are worked out by value ranges and value groups instead."""
    heavy = [m for m in metrics if m == "median"]
    if heavy and not needs_slices(df, group, split):
        heavy = []
    light = [m for m in metrics if m not in heavy]
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            reducer(m)(F.col(c), order).alias(metric_name(c, m))
            for c in columns
            for m in light
        ],
    )
    if heavy:
        medians = exact_quantiles(df, group, columns, [0.5], split=True)
        wide = medians.groupBy(*group).agg(
            *[
                F.max(F.when(F.col("column") == c, F.col("quantiles")[0])).alias(metric_name(c, "median"))
                for c in columns
            ]
        )
        out = out.join(wide, list(group), "left")
    names = [metric_name(c, m) for c in columns for m in metrics]
    return out.select(*group, *names)


def _add_empty_buckets(
    df: DataFrame, part: Sequence[str], ts: str, step: int | Column, zero: Sequence[str]
) -> DataFrame:
    """Rows for the buckets missing between the first and last bucket of a key.

    Each bucket emits itself and the gap up to the next one, so there is no
    join against a generated grid; a key holds at most a day of buckets.
    """
    size = step if isinstance(step, Column) else F.lit(step)
    w = Window.partitionBy(*part).orderBy(ts)
    values = [c for c in df.columns if c not in part and c != ts]
    at = F.unix_micros(ts)
    following = F.unix_micros(F.lead(ts).over(w))
    own = F.col("_at") == F.unix_micros(ts)
    spread = df.withColumn("_until", F.coalesce(following - size, at)).withColumn(
        "_at", F.explode(F.sequence(at, F.col("_until"), size))
    )

    def value(c: str) -> Column:
        kept = F.when(own, F.col(c))
        return (kept.otherwise(F.lit(0)) if c in zero else kept).alias(c)

    order = [c for c in df.columns if c not in values and c != ts]
    return spread.select(*order, F.timestamp_micros("_at").alias(ts), *[value(c) for c in values])


def round_metrics(df: DataFrame, decimals: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Round metric columns half to even; a negative number of decimals does nothing."""
    if decimals < 0:
        return df
    columns = data_columns(df) if columns is None else columns
    types = dict(df.dtypes)
    return df.withColumns(
        {c: round_even(F.col(c), decimals) for c in columns if types[c] in ("double", "float")}
    )


def tumble(
    df: DataFrame,
    window: str,
    metrics: Sequence[str] = DEFAULT_METRICS,
    *,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    dense: bool = True,
    decimals: int = -1,
    split: bool | None = None,
) -> DataFrame:
    """Every data column times every metric per tumbling bucket of a key.

    Buckets start at midnight of the day. ``dense`` also emits the empty
    buckets between a key's first and last one.
    """
    columns = data_columns(df) if columns is None else list(columns)
    step = micros_of(window)
    order = _row_order(df, ts, metrics)
    staged = df.withColumn("_order", order).withColumn(ts, bucket_start(F.col(ts), step))
    out = _aggregate(staged, [*keys, ts], columns, metrics, F.col("_order"), split)
    return _finish(out, keys, columns, metrics, ts, F.lit(step), dense, decimals)


def _finish(out, part, columns, metrics, ts, step, dense, decimals) -> DataFrame:
    if dense:
        zero = [metric_name(c, m) for c in columns for m in metrics if m in ZERO_WHEN_EMPTY]
        out = _add_empty_buckets(out, part, ts, step, zero)
    return round_metrics(out, decimals, [metric_name(c, m) for c in columns for m in metrics])


def multi_window(
    df: DataFrame,
    windows: Sequence[str] = DEFAULT_WINDOWS,
    metrics: Sequence[str] = DEFAULT_METRICS,
    *,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    dense: bool = True,
    decimals: int = -1,
    split: bool | None = None,
) -> DataFrame:
    """The same aggregation for several windows, labelled by ``window``, in one pass."""
    columns = data_columns(df) if columns is None else list(columns)
    steps = {w: micros_of(w) for w in windows}
    labels = F.array(
        *[F.struct(F.lit(w).alias("window"), F.lit(s).alias("step")) for w, s in steps.items()]
    )
    order = _row_order(df, ts, metrics)
    kept = [c for c in (*keys, ts, *columns)]
    staged = (
        df.select(*kept, order.alias("_order"), F.explode(labels).alias("_w"))
        .withColumns({"window": F.col("_w.window"), "_step": F.col("_w.step")})
        .withColumn(ts, bucket_start(F.col(ts), F.col("_step")))
        .drop("_w")
    )
    part = [*keys, "window", "_step"]
    out = _aggregate(staged, [*part, ts], columns, metrics, F.col("_order"), split)
    return _finish(out, part, columns, metrics, ts, F.col("_step"), dense, decimals).drop("_step")


def coalesce_rows(
    df: DataFrame,
    by: Sequence[str] = ("device_id", TS),
    columns: Sequence[str] | None = None,
    domains: Sequence[str] | None = None,
) -> DataFrame:
    """Rows sharing ``by`` become one: the first non-null per column, domains in order.

    Listing the domains turns their order into numbers, which keeps the
    aggregate in fixed-width buffers.
    """
    columns = data_columns(df) if columns is None else list(columns)
    if domains is None:
        order = F.col("domain") if "domain" in df.columns else F.lit(0)
    else:
        order = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    return (
        df.withColumn("_order", order)
        .groupBy(*by)
        .agg(*[F.min_by(c, _kept(F.col(c), F.col("_order"))).alias(c) for c in columns])
    )


def span(df: DataFrame, by: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """First and last timestamp and row count, overall or per group."""
    return df.groupBy(*by).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows")
    )


def row_counts(
    stages: Mapping[str, DataFrame],
    start=None,
    end=None,
    sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Rows per sensor and day, one column per stage, null where a stage has none.

    Each stage is counted before anything is combined, so only the counts meet.
    """
    tallies = None
    for stage, table in stages.items():
        day = F.col("day")
        rows = table
        if start is not None:
            rows = rows.filter(day >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.filter(day <= F.lit(end).cast("date"))
        sensor = F.coalesce(F.col("device_id"), F.lit("(unknown)"))
        tally = (
            rows.groupBy(sensor.alias("device_id"), "day")
            .count()
            .withColumn("stage", F.lit(stage))
        )
        tallies = tally if tallies is None else tallies.unionByName(tally)
    if sensors is not None:
        tallies = tallies.filter(F.col("device_id").isin(list(sensors)))
    return tallies.groupBy("device_id", "day").pivot("stage", list(stages)).agg(F.sum("count"))
