"""Reading versioned stage tables: see ``sinks/versions.py`` for how they are kept."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegrid.functions.scalars import parse_iso_utc
from tidegrid.session import folder_path, list_names, read_text


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    names = list_names(spark, f"{path}/_versions")
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of ``version``; None where there is no versioned table."""
    numbers = version_numbers(spark, path)
    if version is None:
        version = numbers[-1] if numbers else None
    if version is None:
        return None
    if version not in numbers:
        raise ValueError(f"{path} has no version {version}, it has {numbers}")
    return json.loads(read_text(spark, f"{path}/_versions/{version:08d}.json"))


def _days(start, end) -> tuple[str | None, str | None]:
    """First and last day, as text, that rows of ``[start, end)`` can lie in."""
    low = None if start is None else parse_iso_utc(start).date().isoformat()
    if end is None:
        return low, None
    # Half-open: a window ending at midnight does not touch the next day.
    return low, (parse_iso_utc(end) - timedelta(microseconds=1)).date().isoformat()


def partitions_of(found: dict, start=None, end=None, domain: str | None = None) -> list[dict]:
    """Partitions that can hold rows of a window and domain. Rows without a day are in no window."""
    low, high = _days(start, end)
    out = []
    for entry in found["entries"]:
        day = entry["labels"].get("day")
        if domain is not None and entry["labels"].get("domain") != domain:
            continue
        if (low is not None and (day is None or day < low)) or (high is not None and (day is None or day > high)):
            continue
        out.append(entry)
    return out


def read_partitions(spark: SparkSession, path: str, found: dict, entries: Sequence[dict]) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    if not entries:
        return spark.createDataFrame([], schema)
    paths = [
        f"{path}/data/write={e['write']}/{folder_path(spark, list(e['labels'].items()))}".rstrip("/") for e in entries
    ]
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*paths).select(*schema.names)


def read_version(
    spark: SparkSession, path: str, start=None, end=None, domain: str | None = None, version: int | None = None
) -> DataFrame:
    """The table as of its newest version or of ``version``; partitions outside are not opened."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"{path} has no versions")
    return read_partitions(spark, path, found, partitions_of(found, start, end, domain))


def largest_key(spark: SparkSession, path: str, start=None, end=None, domain: str | None = None) -> int | None:
    """Rows of the greatest key, from the manifest; None where there is no versioned table."""
    found = manifest(spark, path)
    return None if found is None else max((e["largest"] for e in partitions_of(found, start, end, domain)), default=0)


def stored_domains(spark: SparkSession, path: str) -> list[str] | None:
    """Domains of the table, from the manifest; None where there is no versioned table."""
    found = manifest(spark, path)
    return None if found is None else sorted({e["labels"]["domain"] for e in found["entries"]})
