"""Stage tables: parquet partitioned by domain and day (and window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import without_nan
from tidegrid.operators.columns import prune_days
from tidegrid.session import configure
from tidegrid.sources.versions import manifest, read_version


# Types of folder columns. Left to inference, ``01`` would become 1 and ``1d`` 1.0.
FOLDER_TYPES = {
    "domain": T.StringType(), "window": T.StringType(), "device_id": T.StringType(), "day": T.DateType()
}


def read_typed(spark: SparkSession, path: str, inner: str = "") -> DataFrame:
    """Parquet in folders, whose columns keep their own types whatever they look like."""
    found = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path + inner)
    fields = [T.StructField(f.name, FOLDER_TYPES.get(f.name, f.dataType)) for f in found.schema]
    return spark.read.option("basePath", path).schema(T.StructType(fields)).parquet(path + inner)


def read_stage(
    spark: SparkSession, path: str, start=None, end=None, domain: str | None = None, schema=None
) -> DataFrame:
    """A stage table; ``start``, ``end`` and ``domain`` prune its partitions.

    Columns may differ between days, so footers are merged, in a distributed
    job. Giving the ``schema`` spares that for tables of very many files, and so do the
    manifests of tables written by ``write_version``, which are read as of the newest one.
    """
    if schema is None and manifest(spark, path) is not None:
        df = read_version(spark, path, domain=domain)
        return without_nan(prune_days(df, start, end))
    if schema is None:
        df = read_typed(spark, path, "/domain=*")
    else:
        df = spark.read.option("basePath", path).schema(schema).parquet(f"{path}/domain=*")
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    return without_nan(prune_days(df, start, end))


def decode_stage_files(df: DataFrame, path_column: str) -> DataFrame:
    """Decode ``experience__device__step[__window]__day`` file names.

    Four or five parts; any other number is an error.
    """
    name = F.regexp_replace(F.element_at(F.split(path_column, "/"), -1), r"\.parquet$", "")
    parts = F.split(name, "__")
    count = F.size(parts)
    bad = F.raise_error(F.concat(F.lit("file name needs 4 or 5 parts: "), name)).cast("string")
    return df.withColumns(
        {
            "experience": F.when(count.isin(4, 5), F.get(parts, F.lit(0))).otherwise(bad),
            "device_id": F.get(parts, F.lit(1)),
            "step": F.get(parts, F.lit(2)),
            "window": F.when(count == 5, F.get(parts, F.lit(3))),
            "day": F.element_at(parts, -1).cast("date"),
        }
    )


def read_file_stage(spark: SparkSession, path: str) -> DataFrame:
    """A stage kept as one file per device and day under ``domain=*/``.

    Files outside such a folder are not read. Metadata comes from the file names.
    Nanosecond times, as pandas writes them, are cut to microseconds.
    """
    df = read_typed(configure(spark), path, "/domain=*/*.parquet")
    if dict(df.dtypes).get("ts") == "bigint":
        df = df.withColumn("ts", F.timestamp_micros(F.expr("ts div 1000")))
    columns = [c for c in df.columns if c != "domain"]
    named = df.select("domain", *columns, F.col("_metadata.file_path").alias("_path"))
    decoded = decode_stage_files(named, "_path")
    return without_nan(
        decoded.select("experience", "device_id", "domain", "step", "window", "day", *columns)
    )


def stage_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a stage with their modification time, sidecar ``.json`` excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").filter(~F.col("path").endswith(".json"))
