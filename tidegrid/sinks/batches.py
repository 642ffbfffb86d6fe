"""Tables that grow by one folder a batch and are merged when they are read.

A batch's rows are written under their own folder, then a small commit file names it: a
batch counts once its commit is there. Writing a batch again finds the commit and does
nothing, so a retried batch changes nothing. ``compact`` merges all committed batches into
one base and commits that; what a base replaced is deleted by the compaction after it, so
that readers of the state before can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.keys import KEYS, SEQ, TS
from tidegrid.operators.merge import first_per
from tidegrid.session import delete_paths, path_exists, put_once

COMMIT = (
    "kind string, number long, stream string, epoch long, position long, folder string, "
    "facts map<string,string>, folded map<string,long>, replaced array<string>"
)
# Position of a row's batch in the order of arrival; 0 in a base.
POSITION = "_batch"


def _commits(spark: SparkSession, path: str) -> list:
    """One small record a batch since the last compaction, and the bases."""
    if not path_exists(spark, f"{path}/commits"):
        return []
    return spark.read.schema(COMMIT).json(f"{path}/commits").collect()


def _base(commits: list):
    return max((c for c in commits if c.kind == "base"), key=lambda c: c.number, default=None)


def _open(commits: list) -> list:
    """Committed batches that no base has folded yet."""
    base = _base(commits)
    folded = base.folded if base else {}
    return [c for c in commits if c.kind == "batch" and c.epoch > folded.get(c.stream, -1)]


def batch_facts(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """What the batches since the last compaction, and the base, were committed with."""
    commits = _commits(spark, path)
    return [dict(c.facts or {}) for c in [*_open(commits), _base(commits)] if c is not None]


def append_batch(
    df: DataFrame, path: str, stream: str, epoch: int, facts: Mapping[str, str] | None = None
) -> bool:
    """Adds batch ``epoch`` of ``stream``; false, and nothing written, if it is there already.

    Only the batch's own rows are written. Batches of several streams are in the order of
    their commits; of two written at once either may come first.
    """
    spark = df.sparkSession
    commits = _commits(spark, path)
    base = _base(commits)
    seen = max((c.epoch for c in commits if c.stream == stream), default=-1)
    if epoch <= max(seen, (base.folded if base else {}).get(stream, -1)):
        return False
    position = 1 + max((c.position for c in commits), default=0)
    folder = f"batches/{stream}-{epoch:012d}"
    # A batch that broke off before its commit is written over.
    df.withColumn(POSITION, F.lit(position)).write.mode("overwrite").parquet(f"{path}/{folder}")
    commit = {
        "kind": "batch", "stream": stream, "epoch": epoch, "position": position, "folder": folder,
        "facts": dict(facts or {}),
    }
    return put_once(spark, f"{path}/commits/batch-{stream}-{epoch:012d}.json", json.dumps(commit))


def read_batches(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    prefer: str = "existing",
) -> DataFrame | None:
    """The merged table, one row per key and time: of several the first to arrive, or with
    ``prefer="new"`` the last. None if nothing was committed."""
    merged = _merged(spark, path, _commits(spark, path), keys, ts, prefer)
    return None if merged is None else merged.drop(POSITION)


def read_all(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows as they came, for tables without a key."""
    rows = _rows(spark, path, _commits(spark, path))
    return None if rows is None else rows.drop(POSITION)


def _rows(spark: SparkSession, path: str, commits: list) -> DataFrame | None:
    base = _base(commits)
    folders = [f"{path}/{c.folder}" for c in _open(commits)]
    parts = [spark.read.option("mergeSchema", "true").parquet(*folders)] if folders else []
    if base is not None:
        parts.append(spark.read.parquet(f"{path}/{base.folder}").withColumn(POSITION, F.lit(0).cast("long")))
    if not parts:
        return None
    first, *more = parts
    for other in more:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def _merged(spark, path, commits, keys, ts, prefer) -> DataFrame | None:
    if prefer not in ("existing", "new"):
        raise ValueError(f"prefer must be 'existing' or 'new', not {prefer!r}")
    rows = _rows(spark, path, commits)
    if rows is None:
        return None
    age = F.col(POSITION).asc() if prefer == "existing" else F.col(POSITION).desc()
    return first_per(rows, [*keys, ts], [age, SEQ] if SEQ in rows.columns else [age])


def compact(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    prefer: str = "existing",
) -> bool:
    """Folds all committed batches into a new base; false if there are none.

    Nothing changes for readers until the base's commit appears. Batches committed
    meanwhile stay open. Of two compactions at once one wins and the other leaves nothing.
    """
    commits = _commits(spark, path)
    open_, base = _open(commits), _base(commits)
    if not open_:
        return False
    number = base.number + 1 if base else 0
    folder = f"base/{number:08d}-{uuid.uuid4().hex[:8]}"
    merged = _merged(spark, path, commits, keys, ts, prefer).drop(POSITION)
    by = [c for c in ("domain", "day") if c in merged.columns]
    merged.hint("rebalance", *by).write.parquet(f"{path}/{folder}")
    folded = dict(base.folded) if base else {}
    for c in open_:
        folded[c.stream] = max(folded.get(c.stream, -1), c.epoch)
    spent = [c.folder for c in open_] + [f"commits/batch-{c.stream}-{c.epoch:012d}.json" for c in open_]
    spent += [base.folder, f"commits/base-{base.number:08d}.json"] if base else []
    facts: dict[str, str] = dict(base.facts or {}) if base else {}
    for c in sorted(open_, key=lambda c: c.position):
        facts = _joined(facts, c.facts or {})
    commit = {
        "kind": "base", "number": number, "position": max(c.position for c in open_), "folder": folder,
        "facts": facts, "folded": folded, "replaced": spent,
    }
    if not put_once(spark, f"{path}/commits/base-{number:08d}.json", json.dumps(commit)):
        delete_paths(spark, [f"{path}/{folder}"])
        return False
    if base is not None:
        delete_paths(spark, [f"{path}/{p}" for p in base.replaced or []])
    return True


def _joined(one: Mapping[str, str], other: Mapping[str, str]) -> dict[str, str]:
    """Facts of several batches: the greatest number under each name."""
    return {k: str(max(int(d[k]) for d in (one, other) if k in d)) for k in {**one, **other}}
