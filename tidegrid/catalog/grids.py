"""Cleaning, time grid, aggregation and normalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegrid.catalog.base import (
    COARSE,
    K,
    READINGS,
    Registry,
    coarse,
    r6,
    readings,
    round_all,
    sql_bucket,
    sql_floor,
    sql_r6,
)
from tidegrid.keys import KEYS
from tidegrid.operators import aggregate as A
from tidegrid.operators import clean as CL
from tidegrid.operators import columns as C
from tidegrid.operators import grid as G
from tidegrid.operators import normalize as N
from tidegrid.plans import counters, flow
from tidegrid.session import scratch_path

QUERIES = Registry()

# --- clean ----------------------------------------------------------------------

DEDUP = f"""deduped AS (
  SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY {K}, ts ORDER BY seq) = 1)"""


def sql_spikes(source: str, columns: tuple[str, ...], window: int, threshold: float) -> str:
    before, after = CL.frame_of(window)
    masked = ", ".join(
        f"CASE WHEN abs({c} - median(CAST({c} AS DOUBLE)) OVER w) <= {threshold} THEN {c} END AS {c}" for c in columns
    )
    return (
        f"SELECT * REPLACE ({masked}) FROM {source} WINDOW w AS "
        f"(PARTITION BY {K} ORDER BY ts, seq ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    )


BOUNDED = """bounded AS (SELECT * REPLACE (CASE WHEN m0 BETWEEN 1 AND 300 THEN m0 END AS m0,
  CASE WHEN m1 BETWEEN 1 AND 300 THEN m1 END AS m1) FROM deduped)"""
CLEANED = f"""{COARSE}, {DEDUP}, {BOUNDED}, cleaned AS ({sql_spikes('bounded', ('m0', 'm1'), 10, 40)})"""
RULES = {"min_value": 1, "max_value": 300, "spike_window": 10, "spike_threshold": 40}


def cleaned(spark, sf_dir):
    return CL.clean(coarse(spark, sf_dir), **RULES)


@QUERIES.add(f"WITH {COARSE}, {DEDUP} SELECT * FROM deduped")
def drop_duplicates(spark, sf_dir):
    return CL.drop_duplicates(coarse(spark, sf_dir))


@QUERIES.add(f"WITH {READINGS} {sql_spikes('readings', ('m0', 'm1'), 10, 60)}")
def mask_spikes(spark, sf_dir):
    return CL.mask_spikes(readings(spark, sf_dir), window=10, threshold=60)


@QUERIES.add(f"WITH {READINGS} {sql_spikes('readings', ('m0', 'm1'), 7, 60)}")
def mask_spikes_sliced(spark, sf_dir):
    """The same through blocks of rows, as for keys too big for one task."""
    return CL.mask_spikes(
        readings(spark, sf_dir), window=7, threshold=60, split=True, block_rows=1_000
    )


@QUERIES.add(f"WITH {READINGS} {sql_spikes('readings', ('m0', 'm1'), 301, 60)}")
def mask_spikes_wide(spark, sf_dir):
    """Frames of 301 rows."""
    return CL.mask_spikes(readings(spark, sf_dir), window=301, threshold=60)


# All readings of a day at one time: only their order tells them apart.
AT_ONCE = """at_once AS (SELECT * REPLACE (CAST("day" AS TIMESTAMP) AS ts) FROM readings)"""


@QUERIES.add(f"WITH {READINGS}, {AT_ONCE} {sql_spikes('at_once', ('m0', 'm1'), 64, 60)}")
def mask_spikes_hot_second(spark, sf_dir):
    """Frames of 64 rows where a key's rows all fall into one second."""
    df = readings(spark, sf_dir)
    return CL.mask_spikes(df.withColumn("ts", F.col("day").cast("timestamp")), window=64, threshold=60)


@QUERIES.add(f"WITH {CLEANED} SELECT * FROM cleaned")
def clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


@QUERIES.add(f"WITH {CLEANED} SELECT * FROM cleaned")
def clean_sliced(spark, sf_dir):
    return CL.clean(coarse(spark, sf_dir), split=True, **RULES)


@QUERIES.add(
    f"""WITH {CLEANED}, t AS (SELECT {K}, count(*) AS rows_in FROM coarse GROUP BY ALL),
    d AS (SELECT {K}, count(*) AS rows_out,
            count(m0) FILTER (m0 NOT BETWEEN 1 AND 300) + count(m1) FILTER (m1 NOT BETWEEN 1 AND 300) AS bounds_nulled
          FROM deduped GROUP BY ALL),
    b AS (SELECT {K}, count(m0) + count(m1) AS n FROM bounded GROUP BY ALL),
    c AS (SELECT {K}, count(m0) + count(m1) AS n FROM cleaned GROUP BY ALL)
    SELECT {K}, rows_in, rows_out, rows_in - rows_out AS duplicates_dropped, bounds_nulled, b.n - c.n AS spikes_nulled
    FROM t JOIN d USING ({K}) JOIN b USING ({K}) JOIN c USING ({K})"""
)
def clean_quality(spark, sf_dir):
    return CL.quality_metrics(coarse(spark, sf_dir), **RULES)


# --- grid ------------------------------------------------------------------------

# Low values are nulled first, so that firsts, leading nulls and gaps have work.
LOW = """low AS (SELECT * REPLACE (CASE WHEN m0 >= 15 THEN m0 END AS m0, CASE WHEN m1 >= 15 THEN m1 END AS m1) FROM {src})"""


def low(df):
    return C.mask_bounds(df, low=15)


@QUERIES.add(
    f"""WITH {READINGS}, {LOW.format(src='readings')}
    SELECT {K}, {sql_floor('ts', 3600)} AS ts, arg_min(m0, seq) FILTER (m0 IS NOT NULL) AS m0,
      arg_min(m1, seq) FILTER (m1 IS NOT NULL) AS m1 FROM low GROUP BY ALL"""
)
def collapse_nearest(spark, sf_dir):
    """First non-null value in order when rows fall together."""
    return G.collapse(low(readings(spark, sf_dir)), "nearest", unit="1h")


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT {K}, {sql_floor('ts', 1)} AS ts, {sql_r6('avg(m0)')} AS m0, {sql_r6('avg(m1)')} AS m1 FROM readings GROUP BY ALL"""
)
def collapse_second(spark, sf_dir):
    return round_all(G.collapse(readings(spark, sf_dir), "mean"))


@QUERIES.add(
    f"""WITH {READINGS}, {LOW.format(src='readings')},
    s AS (SELECT *, min(ts) FILTER (m0 IS NOT NULL OR m1 IS NOT NULL) OVER (PARTITION BY {K}) AS first_ts FROM low)
    SELECT * EXCLUDE (first_ts) FROM s WHERE first_ts IS NULL OR ts >= first_ts"""
)
def trim_leading_nulls(spark, sf_dir):
    return G.trim_leading_nulls(low(readings(spark, sf_dir)))


def sql_grid(source: str, seconds: int, columns: tuple[str, ...]) -> str:
    """Grid from the floored first time to the last, values by exact match."""
    values = ", ".join(f"s.{c} AS {c}" for c in columns)
    step = f"INTERVAL {seconds} SECOND"
    return f"""SELECT e.experience, e.device_id, e."domain", e."day", g.ts AS ts, {values}
      FROM (SELECT {K}, {sql_floor('min(ts)', seconds)} AS a, max(ts) AS b FROM {source} GROUP BY ALL) e,
        LATERAL (SELECT unnest(generate_series(e.a, e.b, {step})) AS ts) g
      LEFT JOIN {source} s ON s.experience = e.experience AND s.device_id = e.device_id AND s."domain" = e."domain"
        AND s."day" = e."day" AND s.ts = g.ts"""


COLLAPSED = f"""{COARSE}, collapsed AS (SELECT {K}, ts, arg_min(m0, seq) AS m0, arg_min(m1, seq) AS m1 FROM coarse GROUP BY ALL)"""


@QUERIES.add(f"WITH {COLLAPSED} {sql_grid('collapsed', 1800, ('m0', 'm1'))}")
def regular_grid(spark, sf_dir):
    """Half-hour grid over ten-minute rows: off-grid rows only set the ends."""
    return G.regular_grid(G.collapse(readings(spark, sf_dir), "nearest", unit="10min"), "30min")


def sql_ffill(source: str, limit: int, columns: tuple[str, ...]) -> str:
    filled = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in columns)
    return (
        f"SELECT * REPLACE ({filled}) FROM {source} WINDOW w AS "
        f"(PARTITION BY {K} ORDER BY ts ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"
    )


@QUERIES.add(
    f"WITH {COLLAPSED}, grid AS ({sql_grid('collapsed', 600, ('m0', 'm1'))}) {sql_ffill('grid', 2, ('m0', 'm1'))}"
)
def ffill(spark, sf_dir):
    return G.ffill(G.regular_grid(G.collapse(readings(spark, sf_dir), "nearest", unit="10min"), "10min"), 2)


RESAMPLED = f"""{CLEANED}, per_slot AS (SELECT {K}, ts, avg(m0) AS m0, avg(m1) AS m1 FROM cleaned GROUP BY ALL),
  trimmed AS (SELECT * FROM per_slot QUALIFY ts >= min(ts) FILTER (m0 IS NOT NULL OR m1 IS NOT NULL) OVER (PARTITION BY {K})),
  grid AS ({sql_grid('trimmed', 600, ('m0', 'm1'))}),
  filled AS ({sql_ffill('grid', 6, ('m0', 'm1'))}),
  resampled AS (SELECT * REPLACE (CAST(round_even(m1, 0) AS BIGINT) AS m1) FROM filled)"""


@QUERIES.add(f"WITH {RESAMPLED} SELECT * REPLACE ({sql_r6('m0')} AS m0) FROM resampled")
def resample(spark, sf_dir):
    """Cleaned rows onto a ten-minute grid, gaps of up to an hour filled, types restored."""
    out = G.resample(cleaned(spark, sf_dir), freq="10min", max_gap_fill=6, unit="10min", unique_ts=True)
    return out.withColumn("m0", r6("m0"))


# Days of readings in a four-hundredth of their time, on a grid of tenths of a second.
QUICK = f"""quick AS (SELECT * REPLACE (make_timestamp(epoch_us(CAST("day" AS TIMESTAMP)) + (epoch_us(ts) - epoch_us(CAST("day" AS TIMESTAMP))) // 400) AS ts) FROM readings),
  tenths AS (SELECT {K}, make_timestamp((epoch_us(ts) // 100000) * 100000) AS ts, arg_min(m0, (ts, seq)) AS m0, arg_min(m1, (ts, seq)) AS m1 FROM quick GROUP BY ALL)"""
FILLED = f"""filled AS ({sql_ffill('grid', 20, ('m0', 'm1'))})"""


@QUERIES.add(
    f"""WITH {READINGS}, {QUICK},
      grid AS ({sql_grid('tenths', 1, ('m0', 'm1')).replace("INTERVAL 1 SECOND", "INTERVAL 100 MILLISECOND").replace("(epoch_us(min(ts)) // 1000000) * 1000000", "(epoch_us(min(ts)) // 100000) * 100000")}),
      {FILLED} SELECT * FROM filled"""
)
def resample_100ms(spark, sf_dir):
    """A grid of tenths of a second, every day of a key spread over several slices."""
    df = readings(spark, sf_dir)
    day = F.unix_micros(F.col("day").cast("timestamp"))
    quick = df.withColumn("ts", F.timestamp_micros(day + F.floor((F.unix_micros("ts") - day) / 400)))
    return G.resample(quick, freq="100ms", unit="100ms", max_gap_fill=20, method="nearest", slots=200)


@QUERIES.add(
    f"""WITH {READINGS}, per_second AS (SELECT {K}, {sql_floor('ts', 1)} AS ts, arg_min(m0, (ts, seq)) AS m0, arg_min(m1, (ts, seq)) AS m1
        FROM readings GROUP BY ALL),
      grid AS ({sql_grid('per_second', 1, ('m0', 'm1'))}), filled AS ({sql_ffill('grid', 20, ('m0', 'm1'))})
    SELECT {K}, count(*) AS rows, count(m0) AS m0_rows, CAST(sum(m1) AS BIGINT) AS m1_sum, {sql_r6('sum(m0)')} AS m0_sum,
      min(ts) AS first_ts, max(ts) AS last_ts FROM filled GROUP BY ALL"""
)
def resample_seconds(spark, sf_dir):
    """The one-second grid with a 20 s fill over every day, summed up per key."""
    out = G.resample(readings(spark, sf_dir), freq="1s", max_gap_fill=20, method="nearest")
    return out.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("m0").alias("m0_rows"),
        F.sum("m1").alias("m1_sum"),
        r6(F.sum("m0")).alias("m0_sum"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


# --- aggregate -----------------------------------------------------------------------


SQL_METRICS = {
    "mean": lambda c: sql_r6(f"avg({c})"),
    "std": lambda c: sql_r6(f"stddev_samp({c})"),
    "var": lambda c: sql_r6(f"var_samp({c})"),
    "min": lambda c: f"min({c})",
    "max": lambda c: f"max({c})",
    "median": lambda c: sql_r6(f"median(CAST({c} AS DOUBLE))"),
    "count": lambda c: f"count({c})",
    "nunique": lambda c: f"count(DISTINCT {c})",
    "first": lambda c: f"arg_min({c}, (ts, seq))",
    "last": lambda c: f"arg_max({c}, (ts, seq))",
}


def sql_metrics(columns, metrics) -> str:
    return ", ".join(
        f"{SQL_METRICS[m](c)} AS {c}__raw__{m}" for c in columns for m in metrics
    )


ALL_METRICS = ["mean", "std", "min", "max", "median", "count", "first", "last"]


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT {K}, {sql_bucket('ts', 3600)} AS bucket, {sql_metrics(('m0', 'm1'), ALL_METRICS)} FROM readings GROUP BY ALL"""
)
def tumble_hour(spark, sf_dir):
    out = A.tumble(readings(spark, sf_dir), "1h", ALL_METRICS, dense=False)
    return round_all(out.withColumnRenamed("ts", "bucket"))


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT {K}, {sql_bucket('ts', 420)} AS bucket, {sql_metrics(('m0', 'm1'), ['mean', 'var', 'nunique'])} FROM readings GROUP BY ALL"""
)
def tumble_7min(spark, sf_dir):
    """A window that does not divide a day: buckets start at midnight."""
    out = A.tumble(readings(spark, sf_dir), "7min", ["mean", "var", "nunique"], dense=False)
    return round_all(out.withColumnRenamed("ts", "bucket"))


@QUERIES.add(
    f"""WITH {READINGS}, b AS (SELECT {K}, {sql_bucket('ts', 900)} AS bucket, avg(m0) AS mean, stddev_samp(m0) AS std, count(m0) AS n
        FROM readings GROUP BY ALL),
      e AS (SELECT {K}, min(bucket) AS a, max(bucket) AS z FROM b GROUP BY ALL),
      g AS (SELECT {K}, unnest(generate_series(a, z, INTERVAL 900 SECOND)) AS bucket FROM e)
    SELECT {K}, bucket, {sql_r6('mean')} AS m0__raw__mean, {sql_r6('std')} AS m0__raw__std, coalesce(n, 0) AS m0__raw__count
    FROM g LEFT JOIN b USING ({K}, bucket)"""
)
def tumble_dense(spark, sf_dir):
    """Empty buckets between a key's first and last one."""
    out = A.tumble(readings(spark, sf_dir), "15min", ["mean", "std", "count"], columns=["m0"])
    return round_all(out.withColumnRenamed("ts", "bucket"))


def _sql_windows(decimals: int) -> str:
    parts = []
    for label, seconds in (("10min", 600), ("1h", 3600), ("6h", 21600)):
        parts.append(
            f"""SELECT {K}, '{label}' AS "window", bucket AS ts, round_even(mean * {10**decimals}.0, 0) / {10**decimals}.0 AS m0__raw__mean,
            round_even(std * {10**decimals}.0, 0) / {10**decimals}.0 AS m0__raw__std
            FROM (SELECT {K}, unnest(generate_series(a, z, INTERVAL {seconds} SECOND)) AS bucket
                  FROM (SELECT {K}, min({sql_bucket('ts', seconds)}) AS a, max({sql_bucket('ts', seconds)}) AS z
                        FROM readings GROUP BY ALL)) g
            LEFT JOIN (SELECT {K}, {sql_bucket('ts', seconds)} AS bucket, avg(m0) AS mean, stddev_samp(m0) AS std
                       FROM readings GROUP BY ALL) b USING ({K}, bucket)"""
        )
    return f"WITH {READINGS} " + " UNION ALL ".join(parts)


@QUERIES.add(_sql_windows(3))
def multi_window(spark, sf_dir):
    return A.multi_window(
        readings(spark, sf_dir), ["10min", "1h", "6h"], ["mean", "std"], columns=["m0"], decimals=3
    )


# --- normalise -------------------------------------------------------------------------


def sql_fit(group: str, p: tuple[float, float] | None, source: str) -> str:
    parts = []
    for c in ("m0", "m1"):
        lo, hi = (
            (f"min({c})", f"max({c})")
            if p is None
            else (f"quantile_cont(CAST({c} AS DOUBLE), {p[0]})", f"quantile_cont(CAST({c} AS DOUBLE), {p[1]})")
        )
        parts.append(
            f"SELECT {group}, '{c}' AS \"column\", {sql_r6(lo)} AS lo, {sql_r6(hi)} AS hi FROM {source} GROUP BY {group}"
        )
    return " UNION ALL ".join(parts)


RECENT = 'recent AS (SELECT * FROM readings WHERE "day" > (SELECT max("day") FROM readings) - 7)'


@QUERIES.add(f"WITH {READINGS}, {RECENT} {sql_fit('experience, device_id', (0.02, 0.98), 'recent')}")
def fit_percentile(spark, sf_dir):
    """Bounds from the last seven days of data."""
    return N.fit(readings(spark, sf_dir), "percentile", window_days=7)


@QUERIES.add(f"WITH {READINGS} {sql_fit('experience, device_id', (0.02, 0.98), 'readings')}")
def fit_percentile_narrowed(spark, sf_dir):
    """The same bounds by narrowing value ranges, as for groups too big for one task."""
    return N.fit_percentile(readings(spark, sf_dir), split=True)


@QUERIES.add(
    f"""WITH {READINGS}, ends AS (SELECT * REPLACE (CASE m1 % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE m0 END AS m0) FROM readings)
    {sql_fit('experience, device_id', (0.05, 0.95), 'ends')}"""
)
def fit_infinite(spark, sf_dir):
    """Infinite readings are ranks like any other; both plans give the same bounds."""
    kind = F.col("m1") % 50
    ends = readings(spark, sf_dir).withColumn(
        "m0", F.when(kind == 0, float("inf")).when(kind == 1, float("-inf")).otherwise(F.col("m0"))
    )
    narrowed = N.fit_percentile(ends, 5, 95, split=True)
    plain = N.fit_percentile(ends, 5, 95, split=False)
    assert narrowed.exceptAll(plain).isEmpty()
    return narrowed


@QUERIES.add(f"WITH {READINGS}, f AS ({sql_fit('experience', None, 'readings')}) SELECT *, {sql_r6('hi - lo')} AS \"range\" FROM f WHERE hi - lo < 200")
def fit_minmax(spark, sf_dir):
    """One fit per experience, and the ranges that look too small."""
    return round_all(N.check_ranges(N.fit(readings(spark, sf_dir), "minmax", group=("experience",)), 200))


@QUERIES.add(
    f"""WITH {READINGS}, {RECENT}
    SELECT 'percentile' AS method, 2.0::DOUBLE AS percentile_min, 98.0::DOUBLE AS percentile_max, '7' AS fit_window_days,
      (SELECT count(DISTINCT ({K})) FROM recent) AS n_inputs, (SELECT count(DISTINCT device_id) FROM recent) AS n_groups"""
)
def fit_meta(spark, sf_dir):
    df = readings(spark, sf_dir)
    return N.fit_meta(df, N.fit(df, window_days=7), window_days=7)


def _sql_scaled(c: str, clip: bool) -> str:
    ratio = f"({c} - f.{c}_lo) / (f.{c}_hi - f.{c}_lo)"
    clipped = f"CASE WHEN {ratio} < 0 THEN 0.0 WHEN {ratio} > 1 THEN 1.0 ELSE {ratio} END" if clip else ratio
    return sql_r6(f"CASE WHEN f.{c}_hi = f.{c}_lo THEN 0.0 ELSE {clipped} END")


FITTED = f"""f AS (SELECT device_id, {', '.join(
    f"{sql_r6(f'quantile_cont(CAST({c} AS DOUBLE), {q})')} AS {c}_{b}" for c in ('m0', 'm1') for b, q in (('lo', 0.02), ('hi', 0.98)))}
  FROM recent GROUP BY device_id)"""


@QUERIES.add(
    f"""WITH {READINGS}, {RECENT}, {FITTED}
    SELECT r.* REPLACE ({_sql_scaled('m0', True)} AS m0, {_sql_scaled('m1', True)} AS m1) FROM readings r JOIN f USING (device_id)"""
)
def normalize(spark, sf_dir):
    df = readings(spark, sf_dir)
    return round_all(N.normalize(df, N.fit(df, window_days=7)))


@QUERIES.add(
    f"""WITH {READINGS}, {RECENT}, {FITTED}
    SELECT r.*, {_sql_scaled('m0', False)} AS m0__norm, {_sql_scaled('m1', False)} AS m1__norm FROM readings r JOIN f USING (device_id)"""
)
def normalize_patterns(spark, sf_dir):
    """New columns by wildcard, not clipped; the first pattern to claim a name keeps it."""
    df = readings(spark, sf_dir)
    spec = {"m*": "m*__norm", "m0": "m0__norm"}
    fitted = N.fit(df, window_days=7, columns=spec)
    return round_all(N.normalize(df, fitted, columns=spec, clip=False))


# --- counters, sketches, code per key ---------------------------------------------


@QUERIES.add(
    f"""WITH {COLLAPSED}, grid AS ({sql_grid('collapsed', 600, ('m0', 'm1'))}), filled AS ({sql_ffill('grid', 6, ('m0', 'm1'))}),
      n AS (SELECT count(*) AS rows, count(m0) + count(m1) AS given FROM grid), f AS (SELECT count(m0) + count(m1) AS seen FROM filled)
    SELECT rows, seen AS "values", seen - given AS filled FROM n, f"""
)
def quality_resample(spark, sf_dir):
    """Gap-filled values, counted by the job that writes the grid."""
    path = scratch_path(spark, "counted")
    counts = counters.quality_resample(
        readings(spark, sf_dir), lambda df: df.write.parquet(path), freq="10min", unit="10min", method="nearest", max_gap_fill=6
    )
    return spark.createDataFrame([counts], "rows long, values long, filled long")


@QUERIES.add(
    f"""WITH {READINGS} SELECT count(*) AS rows, count(CASE WHEN m0 > 0 THEN 1 END) + count(CASE WHEN m1 > 0 THEN 1 END) + count(m1) AS "values",
      CAST(2 AS BIGINT) AS columns_added, CAST(1 AS BIGINT) AS columns_replaced FROM readings"""
)
def quality_transform(spark, sf_dir):
    """Columns added and replaced, and the values in them."""
    path = scratch_path(spark, "transformed")
    spec = [
        {"function": "identity", "target": {"columns": ["m1"]}, "mode": "replace"},
        {"function": "sqrt_inv", "target": {"domain": "bio_signal"}, "mode": "add"},
    ]
    counts = counters.quality_transform(readings(spark, sf_dir), lambda df: df.write.parquet(path), spec, "bio_signal")
    return spark.createDataFrame([counts], "rows long, values long, columns_added long, columns_replaced long")


@QUERIES.add(
    f"""WITH {READINGS}, d AS (SELECT * FROM readings WHERE "day" > (SELECT max("day") FROM readings) - 10)
    SELECT experience, device_id, 'm0' AS "column", count(m0) AS n, true AS lo_fits, true AS hi_fits FROM d GROUP BY ALL
    UNION ALL SELECT experience, device_id, 'm1', count(m1), true, true FROM d GROUP BY ALL"""
)
def fit_sketched(spark, sf_dir):
    """A fit over ten days from stored sketches of each day; ranks are within the stated error."""
    df = readings(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    N.sketch_days(df, columns=["m0", "m1"]).write.parquet(path)
    fitted = N.fit_sketched(spark.read.parquet(path), 2.0, 98.0, window_days=10)
    recent = N.fit_window_days(df, 10)
    values = recent.select(
        *N.GROUP, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("m0", "m1")])).alias("e")
    ).select(*N.GROUP, "e.*").filter("v IS NOT NULL")

    def fits(bound, p):
        below, upto = (F.count_if(t) / F.count("v") for t in (F.col("v") < F.col(bound), F.col("v") <= F.col(bound)))
        return (below - N.RANK_ERROR <= p) & (upto + N.RANK_ERROR >= p)

    return values.join(F.broadcast(fitted), [*N.GROUP, "column"]).groupBy(*N.GROUP, "column").agg(
        F.count("v").alias("n"), fits("lo", 0.02).alias("lo_fits"), fits("hi", 0.98).alias("hi_fits")
    )


def running_gain(table, factor):
    """Rise of ``m0`` since the row before, times ``factor``, within the rows of one key."""
    values = table["m0"].to_numpy()
    gain = np.concatenate([[np.nan], np.diff(values)]) * factor
    return pa.table({"device_id": table["device_id"], "day": table["day"], "seq": table["seq"], "gain": pa.array(gain, from_pandas=True)})


@QUERIES.add(
    f"""WITH {READINGS} SELECT device_id, "day", seq,
      {sql_r6(f'(m0 - lag(m0) OVER (PARTITION BY {K} ORDER BY ts, seq)) * 2.5')} AS gain FROM readings"""
)
def custom_key_step(spark, sf_dir):
    """User code on each key's rows, as a step of a flow."""
    flow.custom_key_step(
        "running_gain", "device_id string, day date, seq long, gain double", {"factor": ((float,), 1.0)}
    )(running_gain)
    steps = [flow.FlowStep("running_gain", {"factor": 2.5})]
    out = flow.run_flow(steps, {"bio_signal": readings(spark, sf_dir)}, spark=spark)
    return round_all(out["bio_signal"])
