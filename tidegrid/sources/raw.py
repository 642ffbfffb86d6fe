"""Raw key:value lines and the metadata in their file names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import scalars as S
from tidegrid.functions.names import domain_columns
from tidegrid.operators.columns import typed_columns

CUT = "\0"  # between the fields of a parsed line
DATE = r"\d{4}-\d{2}-\d{2}"
# What counts as blank at either end of a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _dated(name: Column, start, end, tz: str) -> Column:
    """Whether the date in a file name can hold rows of ``[start, end)``.

    A file may run past midnight, so the day before the first is read as well; local
    days of another zone reach into the next one too. Names without a date pass, for
    the error they are.
    """
    day = F.regexp_extract(name, f"({DATE})", 1)
    keep = F.lit(True)
    if start is not None:
        keep = keep & (day >= str((S.parse_iso_utc(start) - timedelta(days=1)).date()))
    if end is not None:
        last = S.parse_iso_utc(end) - timedelta(microseconds=1)
        keep = keep & (day <= str((last + timedelta(days=0 if tz == "UTC" else 1)).date()))
    return (day == "") | keep


def read_lines(
    spark: SparkSession, path: str, start=None, end=None, tz: str = "UTC"
) -> DataFrame:
    """``value`` plus the file name and the position of the line in its source.

    ``start`` and ``end`` leave out files by the date in their names, before any is opened.

    A file is split into blocks read in order, so the row id rises along it.
    Large sources may come as folders ``name=<file name>``; the folder then
    stands for the file.
    """
    lines = spark.read.text(path)
    name = F.col("name").cast("string") if "name" in lines.columns else F.col("_metadata.file_name")
    if start is not None or end is not None:
        lines = lines.filter(_dated(name, start, end, tz))
    return lines.select(
        "value", name.alias("source_file"), F.monotonically_increasing_id().alias("seq")
    )


def source_metadata(
    df: DataFrame, name: str = "source_file", substitutions: Sequence[Mapping[str, str]] = ()
) -> DataFrame:
    """Add ``experience``, ``device_id`` and ``file_day`` decoded from a file name.

    Literal replacements come first. The first date is the day; the text before
    it splits on its last underscore. A name without a date is an error.
    """
    # Only what follows the date can be an extension: devices may have dots in their names.
    stem = F.regexp_replace(F.col(name), rf"({DATE}[^.]*)\.[^.]*$", "$1")
    for sub in substitutions:
        stem = F.replace(stem, F.lit(sub["src"]), F.lit(sub["target"]))
    no_date = F.raise_error(F.concat(F.lit("no date in file name: "), F.col(name)))
    # Step by step: what is used several times is worked out once a row.
    day, prefix, device = F.col("_file_day"), F.col("_prefix"), F.col("_device")
    named = (
        df.withColumn("_stem", stem)
        .withColumn("_file_day", F.regexp_extract("_stem", f"({DATE})", 1))
        .withColumn("_prefix", F.rtrim(F.call_function("substring_index", F.col("_stem"), day, F.lit(1)), F.lit("_")))
        .withColumn("_device", F.substring_index(prefix, "_", -1))
    )
    checked = F.when(day == "", no_date.cast("string"))
    experience = F.when(
        F.contains(prefix, F.lit("_")),
        F.left(prefix, F.length(prefix) - F.length(device) - 1),
    ).otherwise("")
    return named.withColumns(
        {
            "experience": experience,
            "device_id": checked.otherwise(device),
            "file_day": checked.otherwise(day).cast("date"),
        }
    ).drop("_stem", "_file_day", "_prefix", "_device")


def parse_kv_lines(
    lines: DataFrame,
    delimiter: str = ";",
    *,
    column: str = "value",
    tz: str = "UTC",
) -> DataFrame:
    """Key:value lines as ``ts``, from the first field, and ``_fields``, cut by NUL.

    NUL characters go first, so a NUL can stand for the delimiter. Blank lines and lines
    without any pair are dropped, fields without a colon are ignored, and of equal keys
    the last one counts. Values are searched as text, one search a column, without arrays.
    """
    text = F.btrim(F.translate(F.col(column), "\0", ""), F.lit(BLANKS))
    return (
        # A pair is a colon somewhere after the first delimiter.
        lines.filter(F.col(column).rlike(f"(?s){re.escape(delimiter)}.*:"))
        .withColumn("_fields", S.once(F.replace(text, F.lit(delimiter), F.lit(CUT))))
        .withColumn("ts", S.once(S.parse_ts(F.substring_index("_fields", CUT, 1), tz)))
        .drop(column)
    )


def value_of(key: str) -> Column:
    """Text of the last pair with this key, or null."""
    if ":" in key or CUT in key:
        return F.lit(None).cast("string")
    start = f"{CUT}{key}:"
    value = F.substring_index(F.substring_index("_fields", start, -1), CUT, 1)
    return F.when(F.contains("_fields", F.lit(start)), value)


def discover_keys(parsed: DataFrame) -> list[str]:
    """Every key seen. A full pass; declare the columns to avoid it."""
    fields = parsed.select(F.posexplode(F.split("_fields", CUT)).alias("at", "field"))
    pairs = fields.filter((F.col("at") > 0) & (F.instr("field", ":") > 0))
    rows = pairs.select(F.substring_index("field", ":", 1).alias("k")).distinct().collect()
    return sorted(r["k"] for r in rows)


def available_keys(parsed: DataFrame, domains: Mapping[str, Mapping], keys: Sequence[str] | None) -> list[str]:
    if keys is not None:
        return list(keys)
    if all("columns" in spec for spec in domains.values()):
        return list(dict.fromkeys(c for spec in domains.values() for c in spec["columns"]))
    return discover_keys(parsed)


def type_domains(
    parsed: DataFrame,
    domains: Mapping[str, Mapping],
    keys: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """One typed table per domain from parsed lines; the day comes from each row's own time."""
    available = available_keys(parsed, domains, keys)
    carried = [c for c in parsed.columns if not c.startswith("_") and c not in ("ts", "day", "file_day")]
    tables = {}
    for domain, spec in domains.items():
        # A value's text is searched once, then looked at several times.
        texts = {c: f"_text{i}" for i, c in enumerate(domain_columns(available, spec))}
        typed = typed_columns(available, spec, lambda key: F.col(texts[key]))
        if typed:
            tables[domain] = parsed.withColumns({t: value_of(c) for c, t in texts.items()}).select(
                *carried,
                F.lit(domain).alias("domain"),
                S.utc_day(F.col("ts")).alias("day"),
                "ts",
                *[v.alias(n) for n, v in typed],
            )
    return tables


def domain_columns_of(
    parsed: DataFrame, domains: Mapping[str, Mapping], keys: Sequence[str] | None = None
) -> dict[str, list[str]]:
    """Output columns of every domain that has any."""
    available = available_keys(parsed, domains, keys)
    found = {}
    for domain, spec in domains.items():
        rename = spec.get("rename", {})
        columns = [rename.get(c, c) for c in domain_columns(available, spec)]
        if columns:
            found[domain] = columns
    return found


def type_rows(
    parsed: DataFrame,
    domains: Mapping[str, Mapping],
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """All domains in one pass over the text: a row per line and domain, other
    domains' columns null. This is the shape to write as a stage."""
    available = available_keys(parsed, domains, keys)
    present = [d for d, spec in domains.items() if domain_columns(available, spec)]
    carried = [c for c in parsed.columns if not c.startswith("_") and c not in ("ts", "day", "file_day")]
    exploded = parsed.withColumn("domain", F.explode(F.array(*[F.lit(d) for d in present])))
    columns: dict[str, Column] = {}
    for domain in present:
        for name, value in typed_columns(available, domains[domain], value_of):
            mine = F.when(F.col("domain") == domain, value)
            columns[name] = F.coalesce(columns[name], mine) if name in columns else mine
    return exploded.select(
        *carried,
        "domain",
        S.utc_day(F.col("ts")).alias("day"),
        "ts",
        *[v.alias(n) for n, v in columns.items()],
    )


def parsed_lines(
    spark: SparkSession,
    path: str,
    *,
    delimiter: str = ";",
    tz: str = "UTC",
    substitutions: Sequence[Mapping[str, str]] = (),
    start=None,
    end=None,
) -> DataFrame:
    """Files ``<experience>_<device>_<day>.csv`` as parsed lines with their metadata."""
    parsed = parse_kv_lines(read_lines(spark, path, start, end, tz), delimiter, tz=tz)
    # Last, so that a filter on time comes before the work on names.
    return source_metadata(parsed, substitutions=substitutions)


def parse_raw(
    spark: SparkSession,
    path: str,
    domains: Mapping[str, Mapping],
    *,
    keys: Sequence[str] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Raw files to one typed table per domain."""
    return type_domains(parsed_lines(spark, path, **options), domains, keys)
