"""Shared views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import floor_ts, round_even
from tidegrid.session import configure


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """``@queries.add(sql)`` registers a function under its own name."""

    def add(self, sql: str | None = None, name: str | None = None):
        def wrap(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plain_times(fn(configure(spark), sf_dir))

            self[name or fn.__name__] = Query(run, sql)
            return fn

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side returns them."""
    return df.select(
        *[
            F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def r6(col: Column | str) -> Column:
    return round_even(F.col(col) if isinstance(col, str) else col, 6)


def round_all(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double, so that the order of summation does not show."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: round_even(F.col(c), decimals) for c in doubles}) if doubles else df


def sql_r6(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 1000000.0, 0) / 1000000.0"


# --- events as sensor readings -------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: the event type is the device, value and ``k`` the sensors."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.lit("EVT").alias("experience"),
        F.col("event_type").alias("device_id"),
        F.lit("bio_signal").alias("domain"),
        F.to_date(ts).alias("day"),
        ts.alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("m0"),
        F.get_json_object("props", "$.k").cast("bigint").alias("m1"),
    )


def coarse(spark: SparkSession, sf_dir: str, unit: str = "10min") -> DataFrame:
    """Readings with times floored, so that a device has several rows at one time."""
    return readings(spark, sf_dir).withColumn("ts", floor_ts(F.col("ts"), unit))


READINGS = """readings AS (
  SELECT 'EVT' AS experience, event_type AS device_id, 'bio_signal' AS "domain",
         CAST(ts AS DATE) AS "day", ts, event_id AS seq, value AS m0,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS m1
  FROM events)"""


def sql_floor(ts: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({ts}) // {seconds * 1_000_000}) * {seconds * 1_000_000})"


def sql_bucket(ts: str, seconds: int) -> str:
    """Bucket start counted from midnight of the day."""
    day = 86_400_000_000
    return (
        f"make_timestamp(epoch_us({ts}) - ((epoch_us({ts}) % {day}) % {seconds * 1_000_000}))"
    )


COARSE = (
    READINGS
    + f""", coarse AS (
  SELECT * REPLACE ({sql_floor('ts', 600)} AS ts) FROM readings)"""
)

K = 'experience, device_id, "domain", "day"'
