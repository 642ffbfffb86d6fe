"""Duplicates, bounds and spikes.

Two plans give the same rows. Where a count shows that every key fits one
task, one exchange and one sort on the key serve dedup and rolling median.
Where some key does not, or frames are wide, copies are trimmed map-side before the
shuffle and the median runs over blocks of rows; each block receives the rows
bordering it, so frames crossing a block's ends are complete. Rows are numbered for
that, which writes them to the scratch folder first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.keys import KEYS, SEQ, TS, data_columns, needs_slices, numbered
from tidegrid.operators.columns import outside

# Frames of more rows are not laid out as columns of the row.
WIDE = 31
# Rows of a block; a frame's rows come on top of them.
BLOCK_ROWS = 50_000


def drop_duplicates(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, seq: str = SEQ
) -> DataFrame:
    """First row per timestamp within a key.

    The rank filter becomes a group limit that runs before the shuffle too, so
    a timestamp with very many copies sends one row per map task.
    """
    w = Window.partitionBy(*keys, ts).orderBy(seq)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _drop_repeats_in_order(df: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Same result from the sort the rolling median needs anyway."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    # Null only before the first row: null times equal each other.
    previous = F.lag(F.struct(ts)).over(w)
    return (
        df.withColumn("_previous", previous)
        .filter(F.col("_previous").isNull() | ~F.col("_previous")[ts].eqNullSafe(F.col(ts)))
        .drop("_previous")
    )


# --- rolling median ----------------------------------------------------------


def frame_of(window: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred frame of ``window`` rows."""
    if window < 1:
        raise ValueError("window must be at least 1")
    return window // 2, (window - 1) // 2


def _is_spike(
    value: Column, frame: Sequence[Column], low: Column, high: Column, threshold: float
) -> Column:
    """``|value - median(frame)| > threshold``, nulls in the frame skipped.

    ``low`` and ``high`` are the extremes of the frame. When they lie within
    the threshold of the value, so does the median: that settles nearly every
    row without sorting.
    """
    limit = F.lit(float(threshold))
    v = value.cast("double")
    calm = (high - v <= limit) & (v - low <= limit)
    ordered = F.sort_array(F.array(*frame), asc=False)
    count = F.size(F.array_compact(ordered))
    upper = F.get(ordered, F.floor((count - 1) / 2).cast("int"))
    lower = F.get(ordered, F.floor(count / 2).cast("int"))
    median = (upper.cast("double") + lower.cast("double")) / 2
    return F.when(calm, F.lit(False)).otherwise(F.abs(v - median) > limit)


def _neighbours_in_key(
    df: DataFrame,
    columns: Sequence[str],
    before: int,
    after: int,
    keys: Sequence[str],
    ts: str,
    seq: str,
) -> DataFrame:
    """Neighbour rows and the extremes of each column's frame, in one window pass."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    frame = w.rowsBetween(-before, after)
    row = F.struct(*columns)
    found = {f"_at{k}": F.lag(row, k).over(w) for k in range(-after, before + 1) if k}
    for c in columns:
        found[f"_low_{c}"] = F.min(c).over(frame)
        found[f"_high_{c}"] = F.max(c).over(frame)
    return df.withColumns(found)


def _in_blocks(
    df: DataFrame,
    columns: Sequence[str],
    window: int,
    threshold: float,
    keys: Sequence[str],
    ts: str,
    seq: str,
    block_rows: int,
    count_as: str | None,
) -> DataFrame:
    """The same masks by blocks of rows, however many rows a key, a second or a frame has.

    Rows are numbered in order of key and time. A block is a run of ``block_rows`` of them,
    and is given the rows of its key that its first and last frames reach. A frame then
    moves through a sorted run of its values, one row in and one out a step.
    """
    before, after = frame_of(window)
    size = max(block_rows, window)
    rows = numbered(df, [*keys, ts, seq], "_at", "spike-rows")
    home, place = F.floor(F.col("_at") / size), F.pmod("_at", F.lit(size))
    blocks = F.array(
        home, F.when(place >= size - before, home + 1), F.when(place < after, home - 1)
    )
    dealt = rows.withColumn("_own", home).withColumn("_block", F.explode(F.array_compact(blocks)))
    schema = T.StructType(list(df.schema.fields))
    if count_as is not None:
        schema = schema.add(count_as, T.IntegerType())

    def mask(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        own = pc.equal(block["_own"], block["_block"])
        counts = np.zeros(block.num_rows, np.int32)
        for c in columns:
            values = block[c].cast(pa.float64(), safe=False).to_numpy()
            frames = pd.Series(values).rolling(window, center=True, min_periods=1)
            spikes = np.abs(values - frames.median().to_numpy()) > threshold
            counts += spikes
            masked = pc.if_else(pa.array(spikes), pa.scalar(None, block[c].type), block[c])
            block = block.set_column(block.schema.get_field_index(c), c, masked)
        if count_as is not None:
            block = block.append_column(count_as, pa.array(counts))
        return block.filter(own).select(schema.names)

    return dealt.groupBy(*keys, "_block").applyInArrow(mask, schema)


def mask_spikes(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    threshold: float,
    window: int = 7,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    seq: str = SEQ,
    split: bool | None = None,
    block_rows: int = BLOCK_ROWS,
    count_as: str | None = None,
) -> DataFrame:
    """Null every value further than ``threshold`` from its centred rolling median.

    The frame counts rows, not time; nulls in it are skipped and it shrinks at
    the ends of the key. ``count_as`` adds the number of values nulled per row.
    Frames of more than ``WIDE`` rows, and keys too big for one task, are worked on in
    blocks of ``block_rows``.
    """
    columns = data_columns(df) if columns is None else list(columns)
    before, after = frame_of(window)
    offsets = [k for k in range(-after, before + 1) if k]
    if not offsets:
        return df if count_as is None else df.withColumn(count_as, F.lit(0))
    if window > WIDE or needs_slices(df, keys, split):
        return _in_blocks(df, columns, window, threshold, keys, ts, seq, block_rows, count_as)
    around = _neighbours_in_key(df, columns, before, after, keys, ts, seq)
    spent = [f"_at{k}" for k in offsets]
    spent += [f"_{end}_{c}" for c in columns for end in ("low", "high")]

    def spike(c: str) -> Column:
        frame = [F.col(f"_at{k}")[c] if k else F.col(c) for k in range(-after, before + 1)]
        return _is_spike(F.col(c), frame, F.col(f"_low_{c}"), F.col(f"_high_{c}"), threshold)

    if count_as is None:
        return around.withColumns({c: F.when(~spike(c), F.col(c)) for c in columns}).drop(*spent)
    flags = {f"_spike_{c}": F.coalesce(spike(c), F.lit(False)) for c in columns}
    around = around.withColumns(flags)
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return around.withColumns(
        {count_as: total, **{c: F.when(~F.col(f"_spike_{c}"), F.col(c)) for c in columns}}
    ).drop(*spent, *flags)


# --- the composed step -------------------------------------------------------


def clean(
    df: DataFrame,
    *,
    min_value: float | None = None,
    max_value: float | None = None,
    spike_window: int = 7,
    spike_threshold: float | None = None,
    drop_dups: bool = True,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    seq: str = SEQ,
    split: bool | None = None,
    counts: bool = False,
) -> DataFrame:
    """Dedup, then bounds, then spikes on the bounded values.

    ``counts`` adds ``_bounds`` and ``_spikes``: values nulled per row.
    """
    columns = data_columns(df) if columns is None else list(columns)
    split = needs_slices(df, keys, split) if (drop_dups or spike_threshold is not None) else False
    if drop_dups:
        alone = split or spike_threshold is None
        df = drop_duplicates(df, keys, ts, seq) if alone else _drop_repeats_in_order(df, keys, ts, seq)
    masks = {}
    tests = {c: outside(F.col(c), min_value, max_value) for c in columns}
    if min_value is not None or max_value is not None:
        masks = {c: F.when(~t, F.col(c)) for c, t in tests.items()}
    if counts:
        hits = [F.coalesce(t.cast("int"), F.lit(0)) for t in tests.values() if t is not None]
        df = df.withColumn("_bounds", sum(hits, F.lit(0)))
    if masks:
        df = df.withColumns(masks)
    if spike_threshold is not None:
        df = mask_spikes(
            df,
            columns,
            threshold=spike_threshold,
            window=spike_window,
            keys=keys,
            ts=ts,
            seq=seq,
            split=split,
            count_as="_spikes" if counts else None,
        )
    elif counts:
        df = df.withColumn("_spikes", F.lit(0))
    return df


def quality_metrics(df: DataFrame, *, keys: Sequence[str] = KEYS, ts: str = TS, **rules) -> DataFrame:
    """Per key: rows in and out, duplicates dropped, values nulled by bounds and by spikes."""
    # Copies of a time are counted where they are dropped, so the input is read once.
    copies = df.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys, ts)))
    sensors = rules.pop("columns", None) or data_columns(df)
    done = clean(copies, keys=keys, ts=ts, counts=True, columns=sensors, **rules).groupBy(*keys).agg(
        (F.sum("_copies") if rules.get("drop_dups", True) else F.count(F.lit(1))).alias("rows_in"),
        F.count(F.lit(1)).alias("rows_out"),
        F.sum("_bounds").alias("bounds_nulled"),
        F.sum("_spikes").alias("spikes_nulled"),
    )
    return done.select(
        *keys,
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("duplicates_dropped"),
        "bounds_nulled",
        "spikes_nulled",
    )


def pass_or_clean(
    tables: dict[str, DataFrame], rules: dict[str, dict], drop_dups: bool = True, **options
) -> dict[str, DataFrame]:
    """Clean the domains that have rules; carry the others unchanged."""
    out = {}
    for domain, table in tables.items():
        rule = rules.get(domain)
        out[domain] = table if rule is None else clean(
            table,
            min_value=rule.get("min_value"),
            max_value=rule.get("max_value"),
            spike_window=rule.get("spike_window", 7),
            spike_threshold=rule.get("spike_threshold"),
            drop_dups=drop_dups,
            **options,
        )
    return out
