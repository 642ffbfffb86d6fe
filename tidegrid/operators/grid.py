"""Regular time grid: collapse to seconds, trim, place on the grid, fill, restore types.

``collapse`` combines map-side and leaves at most one row per second and key,
so everything after it handles at most a day of seconds per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import floor_ts, micros_of, to_long_even
from tidegrid.keys import KEYS, SEQ, TS, broadcast_if_small, data_columns, needs_slices, null_safe_join
from tidegrid.operators.aggregate import reducer
from tidegrid.session import cut_lineage

# Grid points of a slice, for grids of more points a day than seconds: an hour at 100 ms.
SLOTS = 36_000
FILLED = "_filled"
LONG_TYPES = ("bigint", "int", "smallint", "tinyint")


def collapse(
    df: DataFrame,
    method: str = "mean",
    *,
    unit: str = "1s",
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    unique_ts: bool = False,
) -> DataFrame:
    """Floor timestamps to ``unit`` and reduce the rows that fall together.

    ``nearest`` and ``first`` take the first non-null value in (ts, seq) order.
    ``unique_ts`` says the timestamps of a key are distinct, so that they alone
    give the order and the aggregate stays in fixed-width buffers.
    """
    columns = data_columns(df) if columns is None else list(columns)
    reduce = reducer(method)
    order = F.col(ts) if unique_ts or SEQ not in df.columns else F.struct(ts, SEQ)
    return (
        df.select(*keys, *columns, order.alias("_order"), floor_ts(F.col(ts), unit).alias(ts))
        .groupBy(*keys, ts)
        .agg(*[reduce(F.col(c), F.col("_order")).alias(c) for c in columns])
    )


def _any_value(columns: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[F.col(c).isNotNull() for c in columns])


def trim_leading_nulls(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    split: bool | None = None,
) -> DataFrame:
    """Drop the rows of a key before its first row holding any value.

    Null rows in the middle or at the end stay; so do keys with no value at all.
    """
    columns = data_columns(df) if columns is None else list(columns)
    first = F.min(F.when(_any_value(columns), F.col(ts)))
    if needs_slices(df, keys, split):
        starts = df.groupBy(*keys).agg(first.alias("_start"))
        marked = df.join(broadcast_if_small(starts), list(keys))
    else:
        marked = df.withColumn("_start", first.over(Window.partitionBy(*keys)))
    keep = F.col("_start").isNull() | (F.col(ts) >= F.col("_start"))
    return marked.filter(keep).drop("_start")


def regular_grid(
    df: DataFrame,
    freq: str = "1s",
    *,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    gridded: Column | None = None,
) -> DataFrame:
    """One row per grid point from the floored first timestamp to the last one.

    Values are placed by exact match: rows off the grid only set where the grid
    begins and ends. Each occupied grid cell emits itself and the empty cells up
    to the next one, so no join and no driver-side grid is needed. Timestamps of
    a key must be distinct. Keys where ``gridded`` is false pass unchanged.
    """
    columns = data_columns(df) if columns is None else list(columns)
    step = micros_of(freq)
    w = Window.partitionBy(*keys).orderBy(ts)
    at = F.unix_micros(ts)
    applies = F.lit(True) if gridded is None else gridded
    cell = F.when(applies, at - F.pmod(at, F.lit(step))).otherwise(at)
    heads = (
        df.select(*keys, ts, *columns, cell.alias("_cell"), applies.alias("_gridded"))
        .withColumn("_previous", F.lag("_cell").over(w))
        .filter(F.col("_previous").isNull() | (F.col("_previous") != F.col("_cell")))
    )
    following = F.when(F.col("_gridded"), F.lead("_cell").over(w))
    spread = heads.withColumn(
        "_until", F.coalesce(following - F.lit(step), F.col("_cell"))
    ).withColumn("_at", F.explode(F.sequence("_cell", "_until", F.lit(step))))
    own = F.col("_at") == F.unix_micros(ts)
    return spread.select(
        *keys, F.timestamp_micros("_at").alias(ts), *[F.when(own, F.col(c)).alias(c) for c in columns]
    )


def ffill(
    df: DataFrame,
    limit: int,
    columns: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows; 0 does nothing.

    A longer gap gets its first ``limit`` rows filled. The last value and its
    row number run along with the window, so the cost does not grow with the
    limit.
    """
    if limit <= 0:
        return df
    columns = data_columns(df) if columns is None else list(columns)
    w = Window.partitionBy(*keys).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = df.withColumn("_row", F.row_number().over(w))
    seen = {}
    for i, c in enumerate(columns):
        seen[f"_last{i}"] = F.last(c, ignorenulls=True).over(run)
        seen[f"_when{i}"] = F.last(F.when(F.col(c).isNotNull(), F.col("_row")), ignorenulls=True).over(run)
    filled = {
        c: F.when(F.col("_row") - F.col(f"_when{i}") <= limit, F.col(f"_last{i}"))
        for i, c in enumerate(columns)
    }
    return numbered.withColumns(seen).withColumns(filled).drop("_row", *seen)


def restore_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns that were long are rounded half-even back to long, others become double."""
    return df.withColumns(
        {
            c: to_long_even(F.col(c)) if t in LONG_TYPES else F.col(c).cast("double")
            for c, t in types.items()
        }
    )


def _resample_in_slices(
    collapsed: DataFrame,
    step: int,
    limit: int,
    columns: Sequence[str],
    keys: Sequence[str],
    ts: str,
    slots: int,
) -> DataFrame:
    """Trim, grid and fill with a key spread over slices of ``slots`` grid points.

    Two levels: the last values of each slice are found by an aggregate and handed on from
    slice to slice, one record a slice; within a slice they lead its rows as a first row. A row
    emits the grid points up to the next row or the slice's end, so that no task holds a
    key and no array is longer than a slice, whatever the gap.
    """
    length = step * slots
    at = F.unix_micros(ts)
    cell = at - F.pmod(at, F.lit(step))
    rows = collapsed.withColumn("_cell", cell).withColumn("_slice", F.col("_cell") - F.pmod("_cell", F.lit(length)))
    rows = cut_lineage(rows, "collapsed")
    first = F.min(F.when(_any_value(columns), F.col("_cell")))
    ends = cut_lineage(
        rows.groupBy(*keys).agg(first.alias("_from"), F.max("_cell").alias("_to")), "grid-ends"
    )
    # Values off the grid are not placed: they only set the ends.
    placed = rows.filter(F.col("_cell") == at)
    values = {f"_v{i}": F.when(F.col(c).isNotNull(), F.struct("_cell", F.col(c).alias("v"))) for i, c in enumerate(columns)}
    last = placed.groupBy(*keys, "_slice").agg(*[F.max(v).alias(n) for n, v in values.items()])
    gridded = ends.filter("_from IS NOT NULL")

    def slice_of(column: str) -> Column:
        return F.col(column) - F.pmod(column, F.lit(length))

    slices = gridded.withColumn("_slice", F.explode(F.sequence(slice_of("_from"), slice_of("_to"), F.lit(length))))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = null_safe_join(slices, last, [*keys, "_slice"], "left").select(
        *keys,
        "_slice",
        F.greatest("_slice", "_from").alias("_cell"),
        F.least(F.col("_slice") + (length - step), "_to").alias("_end"),
        *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in values],
    )
    own = placed.select(*keys, "_slice", "_cell", F.lit(None).cast("long").alias("_end"), *[v.alias(n) for n, v in values.items()])
    part = Window.partitionBy(*keys, "_slice").orderBy("_cell", F.col("_end").isNull())
    run = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = carried.unionByName(own).withColumns(
        {
            "_next": F.lead("_cell").over(part),
            # Null before the slice's first row: rows ahead of the first value.
            "_last": F.last("_end", ignorenulls=True).over(run),
            **{n: F.last(n, ignorenulls=True).over(run) for n in values},
        }
    )
    until = F.coalesce(F.col("_next") - step, F.col("_last"))
    points = F.when(F.col("_last").isNotNull() & (until >= F.col("_cell")), F.sequence("_cell", until, F.lit(step)))
    reach = F.lit(max(limit, 0) * step)
    filled = known.withColumn("_point", F.explode(points)).select(
        *keys,
        F.timestamp_micros("_point").alias(ts),
        *[
            F.when(F.col("_point") - F.col(f"_v{i}._cell") <= reach, F.col(f"_v{i}.v")).alias(c)
            for i, c in enumerate(columns)
        ],
        sum(
            (
                F.coalesce((F.col("_point") - F.col(f"_v{i}._cell")).between(1, reach), F.lit(False)).cast("int")
                for i in range(len(columns))
            ),
            F.lit(0),
        ).alias(FILLED),
    )
    # Keys without any value keep their rows and get no grid.
    bare = null_safe_join(rows, ends.filter("_from IS NULL"), keys, "left_semi").select(
        *keys, ts, *columns, F.lit(0).alias(FILLED)
    )
    return filled.unionByName(bare)


def resample(
    df: DataFrame,
    *,
    freq: str = "1s",
    max_gap_fill: int = 20,
    method: str = "mean",
    unit: str = "1s",
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    unique_ts: bool = False,
    split: bool | None = None,
    slots: int = SLOTS,
    count_as: str | None = None,
) -> DataFrame:
    """Collapse, trim, grid, fill and restore types.

    A key whose rows hold no value at all keeps its collapsed rows and gets no
    grid. Grids finer than a second, or with ``split`` any grid, are worked on in slices of
    ``slots`` grid points. ``count_as`` adds the number of values filled per row.
    """
    columns = data_columns(df) if columns is None else list(columns)
    types = {c: t for c, t in df.dtypes if c in columns}
    out = collapse(df, method, unit=unit, columns=columns, keys=keys, ts=ts, unique_ts=unique_ts)
    if split or (split is None and micros_of(freq) < micros_of("1s")):
        filled = _resample_in_slices(out, micros_of(freq), max_gap_fill, columns, keys, ts, slots)
        filled = filled.drop(FILLED) if count_as is None else filled.withColumnRenamed(FILLED, count_as)
        return restore_types(filled, types)
    # Ordered by time although a minimum needs no order: the grid sorts the same way.
    whole = Window.partitionBy(*keys).orderBy(ts).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    out = out.withColumn("_start", F.min(F.when(_any_value(columns), F.col(ts))).over(whole))
    out = out.filter(F.col("_start").isNull() | (F.col(ts) >= F.col("_start")))
    out = regular_grid(out, freq, columns=columns, keys=keys, ts=ts, gridded=F.col("_start").isNotNull())
    if count_as is None:
        return restore_types(ffill(out, max_gap_fill, columns, keys=keys, ts=ts), types)
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    filled = ffill(out.withColumn(FILLED, missing), max_gap_fill, columns, keys=keys, ts=ts)
    counted = filled.withColumn(FILLED, F.col(FILLED) - missing).withColumnRenamed(FILLED, count_as)
    return restore_types(counted, types)
