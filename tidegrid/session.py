"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. AQE coalesces small shuffle
# partitions, splits skewed join partitions and skewed REBALANCE partitions.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Generated methods above 8000 bytes of bytecode are never compiled by HotSpot.
    # At this limit Spark uses per-expression code instead, in methods small enough.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Files written by pandas hold nanoseconds, which Spark reads as plain longs.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session.

    Python workers on this machine find the package where the driver found it; on a
    cluster it is installed or sent with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    for name, value in SQL_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(
    cpus: int | str = "*", memory: str = "8g", app: str = "tidegrid", scratch: str | None = None
) -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SQL_SETTINGS,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8" if cpus == "*" else str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if scratch is not None:
        settings["spark.checkpoint.dir"] = scratch
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing and the
    session is local; on a cluster a missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "tidegrid-scratch")


_MADE: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.add(path)
    return path


def scratch_made() -> frozenset[str]:
    """The scratch copies this process has made and not deleted."""
    return frozenset(_MADE)


def clear_scratch(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete scratch copies this process has made, all or those given, once their results are written."""
    gone = sorted(_MADE if paths is None else _MADE.intersection(paths))
    delete_paths(spark, gone)
    _MADE.difference_update(gone)


def read_by(df: DataFrame, paths: Iterable[str]) -> set[str]:
    """Those scratch copies that ``df`` still reads."""
    folders = {part for file in df.inputFiles() for part in file.split("/")}
    return {p for p in paths if p.rsplit("/", 1)[1] in folders}


# Spark deletes the shuffle files of a statement at its end, not when the driver happens to
# collect garbage. Only for writes: their plans are never run a second time.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes ``df`` and leaves no shuffle files behind."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """A scratch copy of ``df`` for the length of a ``with`` block, deleted at its end."""
    path = scratch_path(df.sparkSession, label)
    try:
        write_scratch(df, path)
        yield df.sparkSession.read.parquet(path)
    finally:
        delete_paths(df.sparkSession, [path])
        _MADE.discard(path)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    The copy survives lost executors, and both readers of the result see the
    same rows.
    """
    path = scratch_path(df.sparkSession, label)
    write_scratch(df, path)
    return df.sparkSession.read.parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in whatever store they lie. Needs a session with a JVM of its own."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole or not at all; false if there is one already."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        return False
    # Readers leave out names that begin with an underscore.
    draft = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = store.create(draft, True)
    stream.writeBytes(text)
    stream.close()
    if store.rename(draft, target):
        return True
    store.delete(draft, False)
    return False


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def folder_path(spark: SparkSession, values: list[tuple[str, object]]) -> str:
    """The folders of a partition, with its values escaped as Spark writes them."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(
        utils.getPartitionPathString(name, None if value is None else str(value)) for name, value in values
    )
