"""Fit per-group bounds and scale columns with them.

Bounds are a table ``(group…, column, lo, hi)``, one row per group and column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.names import column_pairs
from tidegrid.functions.scalars import round_even
from tidegrid.keys import KEYS, broadcast_if_small, data_columns
from tidegrid.operators.quantiles import exact_quantiles

# One fit per device; ("experience",) gives one fit for a whole experience.
GROUP = ("experience", "device_id")
# Decimals kept in fitted bounds.
BOUND_DECIMALS = 6

# Size of a day's quantile sketch, and the rank error it is good for after merging.
SKETCH_K = 1_000
RANK_ERROR = 0.01


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("bigint", "int", "smallint", "tinyint", "double", "float")
    types = dict(df.dtypes)
    return [c for c in data_columns(df) if types[c] in kinds]


def pairs_of(df: DataFrame, spec) -> list[tuple[str, str]]:
    """(input, output) columns: wildcard patterns and the default see numeric columns only."""
    listed = spec and not hasattr(spec, "items")
    return column_pairs(data_columns(df) if listed else numeric_columns(df), spec)


def fit_window_days(df: DataFrame, days: int) -> DataFrame:
    """Only the last ``days`` days of available data, over all devices; 0 keeps all.

    The newest day is one scalar read from the day column, so the filter that
    follows is a constant and prunes partitions.
    """
    if days <= 0:
        return df
    newest = df.agg(F.max("day").alias("day")).first()["day"]
    if newest is None:
        return df
    return df.filter(F.col("day") > F.date_sub(F.lit(newest), days))


def fit_percentile(
    df: DataFrame,
    p_min: float = 2.0,
    p_max: float = 98.0,
    *,
    columns=None,
    group: Sequence[str] = GROUP,
    split: bool | None = None,
) -> DataFrame:
    """Exact interpolated percentiles of all non-null values of a group."""
    inputs = list(dict.fromkeys(c for c, _ in pairs_of(df, columns)))
    fitted = exact_quantiles(df, list(group), inputs, [p_min / 100, p_max / 100], split)
    bounds = F.col("quantiles")
    return fitted.select(
        *group,
        "column",
        round_even(bounds[0], BOUND_DECIMALS).alias("lo"),
        round_even(bounds[1], BOUND_DECIMALS).alias("hi"),
    )


def fit_minmax(df: DataFrame, *, columns=None, group: Sequence[str] = GROUP) -> DataFrame:
    inputs = list(dict.fromkeys(c for c, _ in pairs_of(df, columns)))
    ends = df.groupBy(*group).agg(
        *[f(F.col(c).cast("double")).alias(f"_{tag}{i}") for i, c in enumerate(inputs) for tag, f in (("lo", F.min), ("hi", F.max))]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
            for i, c in enumerate(inputs)
        ]
    )
    return (
        ends.select(*group, F.explode(entries).alias("_e"))
        .select(*group, "_e.*")
        .filter(F.col("lo").isNotNull())
        .withColumns({b: round_even(F.col(b), BOUND_DECIMALS) for b in ("lo", "hi")})
    )


def sketch_days(
    df: DataFrame, *, columns=None, group: Sequence[str] = GROUP, k: int = SKETCH_K
) -> DataFrame:
    """A quantile sketch of every column, group and day: rows (group, day, column, n, sketch).

    Sketches are some kilobytes whatever the day holds, are combined map-side and can be
    stored; days that come later only add rows.
    """
    inputs = list(dict.fromkeys(c for c, _ in pairs_of(df, columns)))
    entries = []
    for i, c in enumerate(inputs):
        value = F.col(c).cast("double")
        entries += [F.count(value).alias(f"_n{i}"), F.kll_sketch_agg_double(value, F.lit(k)).alias(f"_s{i}")]
    found = df.groupBy(*group, "day").agg(*entries) if inputs else df.select(*group, "day").distinct()
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(inputs)]
    )
    if not inputs:
        rows = F.array().cast("array<struct<column:string,n:bigint,sketch:binary>>")
    return found.select(*group, "day", F.explode(rows).alias("_e")).select(*group, "day", "_e.*").filter("n > 0")


def fit_sketched(
    sketches: DataFrame,
    p_min: float = 2.0,
    p_max: float = 98.0,
    *,
    window_days: int = 0,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Percentiles from the stored sketches of the last ``window_days`` days; no reading is read.

    Bounds are values of the data. Their rank is off by less than ``RANK_ERROR`` of the
    group's rows, with 99% probability at the default size of the sketches.
    """
    recent = fit_window_days(sketches, window_days)
    merged = recent.groupBy(*group, "column").agg(F.kll_merge_agg_double("sketch").alias("_s"))

    def bound(p: float) -> Column:
        value = F.kll_sketch_get_quantile_double("_s", F.lit(float(p) / 100))
        return round_even(value, BOUND_DECIMALS)

    return merged.select(*group, "column", bound(p_min).alias("lo"), bound(p_max).alias("hi"))


def fit(
    df: DataFrame,
    method: str = "percentile",
    *,
    p_min: float = 2.0,
    p_max: float = 98.0,
    window_days: int = 0,
    columns=None,
    group: Sequence[str] = GROUP,
    split: bool | None = None,
) -> DataFrame:
    recent = fit_window_days(df, window_days)
    if method == "percentile":
        return fit_percentile(recent, p_min, p_max, columns=columns, group=group, split=split)
    if method == "minmax":
        return fit_minmax(recent, columns=columns, group=group)
    if method == "sketch":
        return fit_sketched(sketch_days(recent, columns=columns, group=group), p_min, p_max, group=group)
    raise ValueError(f"unknown fit method {method!r}")


def fit_meta(
    df: DataFrame,
    params: DataFrame,
    method: str = "percentile",
    *,
    p_min: float = 2.0,
    p_max: float = 98.0,
    window_days: int = 0,
    group: Sequence[str] = GROUP,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row describing a fit: method, bounds, window, inputs used, groups fitted."""
    inputs = fit_window_days(df, window_days).select(*keys).distinct()
    groups = params.select(*group).distinct()
    tally = inputs.select(F.lit(1).alias("i"), F.lit(0).alias("g")).unionByName(
        groups.select(F.lit(0).alias("i"), F.lit(1).alias("g"))
    )
    return tally.agg(F.sum("i").alias("n_inputs"), F.sum("g").alias("n_groups")).select(
        F.lit(method).alias("method"),
        F.lit(float(p_min)).alias("percentile_min"),
        F.lit(float(p_max)).alias("percentile_max"),
        F.lit(str(window_days) if window_days > 0 else "all").alias("fit_window_days"),
        "n_inputs",
        "n_groups",
    )


def check_ranges(params: DataFrame, min_range: float) -> DataFrame:
    """Bounds closer together than ``min_range``; 0 reports nothing."""
    width = (F.col("hi") - F.col("lo")).alias("range")
    if min_range <= 0:
        return params.select("*", width).filter(F.lit(False))
    return params.select("*", width).filter(F.col("hi") - F.col("lo") < min_range)


def scale(value: Column, lo: Column, hi: Column, clip: bool = True) -> Column:
    """``(value - lo) / (hi - lo)``; equal bounds give 0 for every row, null included."""
    spread = hi - lo
    ratio = F.when(spread != 0, (value.cast("double") - lo) / spread)
    if clip:
        # least and greatest skip nulls, so clip by comparison.
        ratio = F.when(ratio < 0, 0.0).when(ratio > 1, 1.0).otherwise(ratio)
    return F.when(spread == 0, F.lit(0.0)).otherwise(ratio)


def missing_groups(df: DataFrame, params: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Groups of ``df`` without any fitted bounds."""
    return df.select(*group).distinct().join(params.select(*group).distinct(), list(group), "left_anti")


def normalize(
    df: DataFrame,
    params: DataFrame,
    *,
    columns=None,
    clip: bool = True,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Scale columns by the bounds of their group.

    A group without bounds fails the query when its rows are computed. A column
    without bounds in a fitted group stays as it is, or null if it is new.
    """
    pairs = pairs_of(df, columns)
    inputs = list(dict.fromkeys(c for c, _ in pairs))
    slot = {c: i for i, c in enumerate(inputs)}
    wide = params.groupBy(*group).agg(
        F.lit(True).alias("_fitted"),
        *[
            F.max(F.when(F.col("column") == c, F.col(b))).alias(f"_{b}{i}")
            for c, i in slot.items()
            for b in ("lo", "hi")
        ],
    )
    joined = df.join(broadcast_if_small(wide), list(group), "left")
    name = F.concat_ws("/", *[F.col(g).cast("string") for g in group])
    unknown = F.raise_error(F.concat(F.lit("no fitted bounds for "), name)).cast("double")
    results = {}
    for source, out in pairs:
        lo, hi = F.col(f"_lo{slot[source]}"), F.col(f"_hi{slot[source]}")
        untouched = F.col(out).cast("double") if out in df.columns else F.lit(None).cast("double")
        results[out] = (
            F.when(F.col("_fitted").isNull(), unknown)
            .when(lo.isNull(), untouched)
            .otherwise(scale(F.col(source), lo, hi, clip))
        )
    order = df.columns + [o for o in results if o not in df.columns]
    return joined.withColumns(results).select(*order)
