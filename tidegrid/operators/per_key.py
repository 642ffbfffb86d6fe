"""User code on the rows of one key, as Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.functions.scalars import bucket_start, micros_of
from tidegrid.keys import KEYS, ROWS_PER_TASK, SEQ, TS, needs_slices


def apply_per_key(
    df: DataFrame,
    fn: Callable[[pa.Table], pa.Table],
    schema: T.StructType | str,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    slice_length: str | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """``fn`` applied to the rows of each key, in order of time and ``seq``.

    ``schema`` declares what ``fn`` returns and is checked: other names, or values that do not
    fit the declared types, raise. A key's rows meet in one task, so a key of more than
    ``limit`` rows is refused, unless ``slice_length`` says that ``fn`` may see
    the key in slices of time, counted from midnight. Null keys are a key, an empty table gives an
    empty table.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    by = list(keys)
    if slice_length is not None:
        df = df.withColumn("_slice", bucket_start(F.col(ts), micros_of(slice_length)))
        by.append("_slice")
    if needs_slices(df, by, None, limit):
        raise ValueError(f"a key has more than {limit} rows: give a slice length, or a shorter one")
    order = [(c, "ascending") for c in (ts, SEQ) if c in df.columns]
    given = [c for c in df.columns if c != "_slice"]
    wanted = to_arrow_schema(declared)

    def run(table: pa.Table) -> pa.Table:
        result = fn(table.sort_by(order).select(given))
        if not isinstance(result, pa.Table):
            raise TypeError(f"a step per key returns an Arrow table, not {type(result).__name__}")
        if set(result.column_names) != set(wanted.names):
            raise ValueError(f"columns {sorted(result.column_names)} are not the declared {sorted(wanted.names)}")
        try:
            return result.select(wanted.names).cast(wanted)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as problem:
            raise ValueError(f"values do not fit the declared types: {problem}") from problem

    return df.groupBy(*by).applyInArrow(run, declared)
