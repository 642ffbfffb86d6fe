"""Projections, filters and per-row masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import names
from tidegrid.functions import scalars as S
from tidegrid.keys import RESERVED, TS, data_columns


# --- domains -----------------------------------------------------------------


def typed_columns(
    available: Sequence[str], spec: Mapping, value_of=F.col
) -> list[tuple[str, Column]]:
    """(name, expression) of a domain's columns after coercion and renaming."""
    coerce = S.coerce_int if spec.get("dtype", "float") == "int" else S.coerce_float
    rename = spec.get("rename", {})
    return [
        (rename.get(c, c), coerce(value_of(c)))
        for c in names.domain_columns(available, spec)
    ]


def split_domains(raw: DataFrame, domains: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """One typed table per domain. Every row is kept, even with no value in it.

    A domain without any matching column is left out.
    """
    carried = [c for c in raw.columns if c in RESERVED and c != "domain"]
    available = [c for c in raw.columns if c not in RESERVED]
    tables = {}
    for domain, spec in domains.items():
        typed = typed_columns(available, spec)
        if typed:
            tables[domain] = raw.select(
                *carried, F.lit(domain).alias("domain"), *[v.alias(n) for n, v in typed]
            )
    return tables


def stack_domains(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table with the union of columns, missing ones null."""
    stacked = None
    for table in tables.values():
        stacked = table if stacked is None else stacked.unionByName(table, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no domain to stack")
    return stacked


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def keep_domains(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    return df.filter(F.col("domain").isin(list(domains)))


def drop_domains(df: DataFrame, domains: Sequence[str], target: str | None = None) -> DataFrame:
    """Discard the listed domains; the target domain is never dropped."""
    listed = [d for d in domains if d != target]
    return df.filter(~F.col("domain").isin(listed)) if listed else df


# --- time ranges -------------------------------------------------------------


def trim_time(df: DataFrame, start=None, end=None, ts: str = TS) -> DataFrame:
    """Rows within ``[start, end]``, both ends included."""
    if start is not None:
        df = df.filter(F.col(ts) >= S.moment(start))
    if end is not None:
        df = df.filter(F.col(ts) <= S.moment(end))
    return df


def range_filter(df: DataFrame, start=None, end=None, ts: str = TS) -> DataFrame:
    """Rows within ``[start, end)``; also prunes day partitions when ``day`` is there."""
    if start is not None:
        df = df.filter(F.col(ts) >= S.moment(start))
    if end is not None:
        df = df.filter(F.col(ts) < S.moment(end))
    return prune_days(df, start, end)


def prune_days(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose ``day`` lies in the days of ``[start, end]``; undated rows go.

    A plain predicate on the partition column, so files are pruned.
    """
    if "day" not in df.columns or (start is None and end is None):
        return df
    if start is not None:
        df = df.filter(F.col("day") >= F.lit(S.parse_iso_utc(start).date()))
    if end is not None:
        df = df.filter(F.col("day") <= F.lit(S.parse_iso_utc(end).date()))
    return df


# --- masks and selection -----------------------------------------------------


def outside(col: Column, low=None, high=None) -> Column | None:
    """Condition for a value beyond its limits; the limits themselves are inside."""
    tests = []
    if low is not None:
        tests.append(col < F.lit(low))
    if high is not None:
        tests.append(col > F.lit(high))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def mask_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, low=None, high=None
) -> DataFrame:
    """Values beyond the limits become null; the row stays."""
    columns = data_columns(df) if columns is None else columns
    if low is None and high is None:
        return df
    return df.withColumns({c: F.when(~outside(F.col(c), low, high), F.col(c)) for c in columns})


def select_rename(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = (TS,)) -> DataFrame:
    """Ordered selection with renaming. Missing columns are skipped; an empty map keeps all."""
    if not mapping:
        return df
    present = [(src, dst) for src, dst in mapping.items() if src in df.columns]
    if not present:
        raise ValueError(f"none of the requested columns exist: {sorted(mapping)}")
    return df.select(*keep, *[F.col(src).alias(dst) for src, dst in present])


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def format_columns(df: DataFrame, formats: Mapping[str, Mapping]) -> DataFrame:
    """``dtype: int`` rounds half-even to long; ``decimals`` rounds half-even."""
    changes = {}
    for name, fmt in formats.items():
        if name not in df.columns:
            continue
        col = F.col(name)
        if fmt.get("dtype") == "int":
            col = S.to_long_even(col)
        if "decimals" in fmt:
            rounded = S.round_even(col, fmt["decimals"])
            col = rounded.cast("long") if fmt.get("dtype") == "int" else rounded
        changes[name] = col
    return df.withColumns(changes) if changes else df


def select_aggregation(df: DataFrame, window: str | None = None, domain: str | None = None) -> DataFrame:
    if window is not None:
        df = df.filter(F.col("window") == window)
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    return df


def source_index(sources: Sequence[Mapping]) -> Column:
    """Position of the first source entry that covers a row, or null."""
    choice = None
    for i, source in enumerate(sources):
        test = F.col("domain") == source["domain"]
        if source.get("devices"):
            test = test & F.col("device_id").isin(list(source["devices"]))
        choice = F.when(test, i) if choice is None else choice.when(test, i)
    return F.lit(None).cast("int") if choice is None else choice


def select_source(df: DataFrame, sources: Sequence[Mapping]) -> DataFrame:
    """Keep what the source entries ask for: the first entry covering a row decides.

    Rows no entry covers are dropped; columns the deciding entry does not
    select become null; columns no entry selects are dropped.
    """
    columns = data_columns(df)
    chosen = [
        set(
            names.select_columns(
                columns,
                s.get("sensors"),
                s.get("transforms"),
                s.get("metrics"),
                s.get("columns"),
            )
        )
        for s in sources
    ]
    used = [c for c in columns if any(c in picked for picked in chosen)]
    kept = [c for c in df.columns if c not in columns]
    picked = df.withColumn("_source", source_index(sources)).filter(F.col("_source").isNotNull())

    def value(c: str) -> Column:
        holders = [i for i, picked_here in enumerate(chosen) if c in picked_here]
        if len(holders) == len(chosen):
            return F.col(c)
        return F.when(F.col("_source").isin(holders), F.col(c)).alias(c)

    return picked.select(*kept, *[value(c) for c in used])


# --- transforms --------------------------------------------------------------


def apply_transforms(df: DataFrame, transforms: Sequence[Mapping], domain: str | None = None) -> DataFrame:
    """Apply scalar transforms in order.

    Only columns present before the first transform are transformed: those a
    target lists, or without a list all of them if it names this ``domain``. ``replace`` overwrites and is seen by later entries; ``add``
    writes ``column__function`` right after its source column.
    """
    originals = data_columns(df)
    exprs = {c: F.col(c) for c in originals}
    added: dict[str, dict[str, Column]] = {c: {} for c in originals}
    for spec in transforms:
        function = spec["function"]
        if function not in S.TRANSFORMS:
            raise ValueError(f"unknown transform {function!r}, known: {sorted(S.TRANSFORMS)}")
        target = spec["target"]
        whole = target.get("domain") is not None and target["domain"] == domain
        for c in originals:
            if not (c in target["columns"] if "columns" in target else whole):
                continue
            result = S.TRANSFORMS[function](exprs[c])
            if spec.get("mode", "add") == "replace":
                exprs[c] = result
            else:
                added[c][f"{c}__{function}"] = result
    fresh = {n for group in added.values() for n in group}
    out = []
    for c in df.columns:
        if c in fresh:
            continue
        out.append(exprs[c].alias(c) if c in exprs else F.col(c))
        for name, expr in added.get(c, {}).items():
            out.append(expr.alias(name))
    return df.select(*out)
