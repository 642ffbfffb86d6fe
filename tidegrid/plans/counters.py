"""Counts taken on the way to a sink, in the same job as the write."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegrid.keys import data_columns
from tidegrid.operators.columns import apply_transforms
from tidegrid.operators.grid import resample


def write_counted(
    df: DataFrame, write: Callable[[DataFrame], None], counters: Mapping[str, Column], drop: Sequence[str] = ()
) -> dict[str, int]:
    """Writes ``df`` without the columns ``drop`` and returns aggregates over its rows.

    The aggregates ride along with the write: nothing is read or computed twice. ``write``
    must run one job over its table, as a plain write does.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in counters.items()]).drop(*drop))
    return {n: v or 0 for n, v in seen.get.items()}


def quality_resample(df: DataFrame, write: Callable[[DataFrame], None], **options) -> dict[str, int]:
    """Resamples and writes; counts rows, values and the values filled into gaps."""
    columns = options.pop("columns", None) or data_columns(df)
    out = resample(df, columns=columns, count_as="_filled_values", **options)
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return write_counted(
        out,
        write,
        {"rows": F.count(F.lit(1)), "values": F.sum(present), "filled": F.sum("_filled_values")},
        drop=["_filled_values"],
    )


def quality_transform(
    df: DataFrame, write: Callable[[DataFrame], None], transforms: Sequence[Mapping], domain: str | None = None
) -> dict[str, int]:
    """Transforms and writes; counts rows, columns added, columns replaced and their values."""
    out = apply_transforms(df, transforms, domain)
    added = [c for c in out.columns if c not in df.columns]
    originals = data_columns(df)
    replaced = set()
    for spec in transforms:
        if spec.get("mode", "add") == "replace":
            target = spec["target"]
            whole = domain is not None and target.get("domain") == domain
            replaced |= {c for c in originals if (c in target["columns"] if "columns" in target else whole)}
    made = sum((F.col(c).isNotNull().cast("int") for c in [*added, *sorted(replaced)]), F.lit(0))
    counts = write_counted(out, write, {"rows": F.count(F.lit(1)), "values": F.sum(made)})
    return {**counts, "columns_added": len(added), "columns_replaced": len(replaced)}
