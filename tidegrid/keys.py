"""The unit of computation and the checks that keep one task's share bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

# One key is one device's readings of one domain on one day.
KEYS = ("experience", "device_id", "domain", "day")
TS = "ts"
SEQ = "seq"
RESERVED = frozenset((*KEYS, TS, SEQ, "window", "source_file"))

# Rows one task may hold when an operator walks a whole key in order. Beyond
# it the operator works on blocks of rows instead.
ROWS_PER_TASK = 5_000_000
# Cells (rows times columns) of a table that may be broadcast, some 30 MB; checked, never assumed.
BROADCAST_CELLS = 2_000_000

DAY_MICROS = 86_400_000_000


def data_columns(df: DataFrame) -> list[str]:
    """Sensor columns: everything that is not key, time, order or window."""
    return [c for c in df.columns if c not in RESERVED and not c.startswith("_")]


def largest_group(df: DataFrame, keys: Sequence[str] = KEYS) -> int:
    """Rows of the biggest group. A map-side combined count over the key columns only."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return (row["n"] or 0) if row else 0


def needs_slices(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    split: bool | None = None,
    limit: int = ROWS_PER_TASK,
) -> bool:
    """Whether some key is too big for one task. ``split`` answers for the caller."""
    if split is not None:
        return split
    if df.isStreaming:
        return False
    return largest_group(df, keys) > limit


def broadcast_if_small(df: DataFrame, max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Broadcast hint only when a count shows ``df`` is small.

    Beyond the bound the join is left to Spark: a shuffled join, with AQE
    splitting the partitions of hot keys.
    """
    max_rows = max_cells // max(1, len(df.columns))
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null being equal to null; the left side's columns are kept."""
    renamed = {c: f"_join_{c}" for c in on}
    other = right.withColumnsRenamed(renamed)
    same = [left[c].eqNullSafe(other[r]) for c, r in renamed.items()]
    return left.join(other, same, how).drop(*renamed.values())


def numbered(df: DataFrame, order: Sequence[str], out: str = "_at", label: str = "numbered") -> DataFrame:
    """``df`` stored in ``order`` over all tasks, with the number of each row in it from 0.

    Rows are dealt by ranges of the whole order, so that any number of rows of one key, or
    of one timestamp, is spread; only the tasks' row counts are put in sequence.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Spark's id holds the task in its upper bits and the row within the task below.
    rows = cut_lineage(dealt.withColumn(out, F.monotonically_increasing_id()), label)
    task, inside = F.shiftright(out, 33), F.col(out).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(task.alias("_task")).count()
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = sizes.select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), task == F.col("_task"))
    return placed.withColumn(out, F.col("_start") + inside).drop("_task", "_start")
