"""Run-event logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_EVENT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("treatment", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("input_dir", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("flow", T.StringType()),
        T.StructField("time_from", T.StringType()),
        T.StructField("time_to", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of every log under ``path``; malformed and blank lines are skipped."""
    return (
        spark.read.schema(RUN_EVENT)
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true")
        .json(path)
        .filter(F.col("ts").isNotNull())
    )
