"""Stage tables whose writes make versions: a write that fails leaves the table as it was.

A write adds a folder of new files, one partition folder per domain, window and day that it
touches. Then a manifest lists, for each partition, the write that holds it now; the
highest manifest is the table. Nothing is overwritten, so readers of a version never see
half of the next one, and rows need not be staged to rewrite the table they come from.

The manifest also has the table's schema, and rows and greatest key of each partition:
reading merges no footers, and whether a key fits one task is known without a job. It has
one record a partition, which the driver reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import moment
from tidegrid.keys import KEYS, SEQ, TS
from tidegrid.operators.merge import first_per, merge_append
from tidegrid.session import delete_paths, list_names, put_once
from tidegrid.sources.stage import FOLDER_TYPES
from tidegrid.sources.versions import manifest, partitions_of, read_partitions, version_numbers

LABELS = ("domain", "window", "day")


class ConcurrentWrite(RuntimeError):
    """Another write has made the next version first; the table has that one."""


def _joint_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    fields = {} if old is None else {f.name: f for f in old}
    for f in new:
        known = fields.get(f.name)
        if known is not None and known.dataType != f.dataType:
            raise ValueError(f"column {f.name!r} is {known.dataType.simpleString()} in the table, not {f.dataType.simpleString()}")
        fields[f.name] = T.StructField(f.name, f.dataType)
    return T.StructType(list(fields.values()))


def write_version(
    df: DataFrame,
    path: str,
    mode: str = "replace",
    start=None,
    end=None,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    prefer: str = "existing",
) -> int:
    """Writes as ``write_stage`` does, as the next version of the table; returns its number.

    Null labels are partitions like others. A table keeps the labels it began with, and a
    column its type. Of two writes at once one raises ``ConcurrentWrite`` and changes nothing.
    """
    spark = df.sparkSession
    found = manifest(spark, path)
    labels = found["labels"] if found else [c for c in LABELS if c in df.columns]
    missing = [c for c in labels if c not in df.columns]
    if missing:
        raise ValueError(f"the table is partitioned by {missing}, which the rows lack")
    df = df.withColumns({c: F.col(c).cast(FOLDER_TYPES[c]) for c in labels})
    schema = _joint_schema(T.StructType.fromJson(found["schema"]) if found else None, df.schema)
    entries = found["entries"] if found else []
    kept: list[dict]
    if mode == "reset" or (mode == "replace" and start is None and end is None):
        kept, result = [], df
        schema = _joint_schema(None, df.schema)
    elif mode == "append":
        by = [*keys, "window"] if "window" in labels else list(keys)
        # One row per partition: which ones the new rows touch.
        touched = {_text(r) for r in df.select(*labels).distinct().collect()}
        old = [e for e in entries if tuple(e["labels"].values()) in touched]
        kept = [e for e in entries if tuple(e["labels"].values()) not in touched]
        if old:
            result = merge_append(read_partitions(spark, path, found, old), df, by, ts, prefer=prefer)
        else:
            order = [SEQ] if SEQ in df.columns else [F.xxhash64(*df.columns)]
            result = first_per(df, [*by, ts], order)
    elif mode == "replace":
        inside = F.lit(True)
        if start is not None:
            inside = inside & (F.col(ts) >= moment(start))
        if end is not None:
            inside = inside & (F.col(ts) < moment(end))
        # A time outside its day label would be missed by days: only partitions by day are pruned.
        old = partitions_of(found, start, end) if found and "day" in labels else list(entries)
        chosen = {json.dumps(e) for e in old}
        kept = [e for e in entries if json.dumps(e) not in chosen]
        result = df.filter(inside)
        if old:
            outside = read_partitions(spark, path, found, old).filter(~F.coalesce(inside, F.lit(False)))
            result = outside.unionByName(result, allowMissingColumns=True)
        # New rows of the window in partitions that were not opened: those join in too.
        held = {tuple(e["labels"].values()): e for e in kept}
        more = [held[t] for t in {_text(r) for r in result.select(*labels).distinct().collect()} if t in held]
        if more:
            result = result.unionByName(read_partitions(spark, path, found, more), allowMissingColumns=True)
            kept = [e for e in kept if e not in more]
    else:
        raise ValueError(f"unknown output mode {mode!r}")
    write = uuid.uuid4().hex[:12]
    folder = f"{path}/data/write={write}"
    balanced = result.hint("rebalance", *labels) if labels else result.hint("rebalance")
    balanced.write.partitionBy(*labels).parquet(folder)
    fresh = _facts(spark, folder, schema, labels, [k for k in keys if k in schema.names])
    number = found["version"] + 1 if found else 0
    record = {
        "version": number,
        "labels": labels,
        "schema": json.loads(schema.json()),
        "entries": kept + [{**e, "write": write} for e in fresh],
    }
    if not put_once(spark, f"{path}/_versions/{number:08d}.json", json.dumps(record)):
        delete_paths(spark, [folder])
        raise ConcurrentWrite(f"version {number} of {path} has been written meanwhile")
    return number


def _text(row) -> tuple:
    return tuple(None if v is None else str(v) for v in row)


def _facts(spark, folder: str, schema: T.StructType, labels: Sequence[str], keys: Sequence[str]) -> list[dict]:
    """Rows and greatest key of each written partition: a count over the key columns alone."""
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    by = list(dict.fromkeys([*labels, *keys]))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else rows.agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy(*labels).agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest"))
    return [
        {"labels": dict(zip(labels, _text([r[c] for c in labels]))), "rows": r["rows"], "largest": r["largest"]}
        for r in totals.collect()
        if r["rows"]
    ]


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest ``keep`` versions and the files that only those had."""
    if keep < 1:
        raise ValueError("at least one version stays")
    numbers = version_numbers(spark, path)
    gone, stay = numbers[:-keep], numbers[-keep:]
    used = {e["write"] for n in stay for e in manifest(spark, path, n)["entries"]}
    # Before their files: a version without files would be worse than files without a version.
    delete_paths(spark, [f"{path}/_versions/{n:08d}.json" for n in gone])
    old = set() if not gone else {n.split("=", 1)[1] for n in list_names(spark, f"{path}/data") if n.startswith("write=")}
    delete_paths(spark, [f"{path}/data/write={w}" for w in sorted(old - used)])
    return gone
