"""The streaming operators, run over whole tables with everything available at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import COARSE, K, READINGS, Registry, coarse, readings, round_all, sql_bucket, sql_r6
from tidegrid.catalog.parsing import DOMAINS, kv_lines
from tidegrid.session import scratch_path
from tidegrid.sinks import batches
from tidegrid.streaming import live

QUERIES = Registry()


def as_stream(df, label):
    """The rows of ``df`` as a file stream."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run(spark, stream, label):
    out, log = scratch_path(spark, label), scratch_path(spark, f"{label}-log")
    live.run_to_table(stream, out, log).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def sql_hours(source):
    return f"""SELECT experience, device_id, "domain", {sql_bucket('ts', 3600)} AS bucket, {sql_r6('avg(m0)')} AS m0__raw__mean,
        {sql_r6('stddev_samp(m0)')} AS m0__raw__std, {sql_r6('avg(m1)')} AS m1__raw__mean, {sql_r6('stddev_samp(m1)')} AS m1__raw__std FROM {source} GROUP BY ALL"""


def in_two_batches(spark, first, second, label, run):
    """``run(stream)`` over a growing folder, once with ``first`` there, then again with ``second`` too."""
    path = scratch_path(spark, label)
    for part in (first, second):
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(first.schema).parquet(path)).awaitTermination()


# Every second reading arrives after all the others: many are too late by then.
HALVES = f"""{READINGS}, late AS (SELECT * FROM readings WHERE seq % 2 = 1
      AND {sql_bucket('ts', 3600)} + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings WHERE seq % 2 = 0) - INTERVAL 2 HOUR)"""


@QUERIES.add(f"WITH {READINGS} {sql_hours('readings')}")
def stream_tumble(spark, sf_dir):
    """Hourly metrics of all rows, the buckets still open at the end included."""
    stream = as_stream(readings(spark, sf_dir), "tumble-in")
    out, log = scratch_path(spark, "tumble-out"), scratch_path(spark, "tumble-log")
    live.tumble_to_table(stream, "1h", out, log, columns=["m0", "m1"]).awaitTermination()
    return round_all(live.read_tumbled(spark, out).withColumnRenamed("ts", "bucket"))


@QUERIES.add(f"WITH {HALVES}, seen AS (SELECT * FROM readings ANTI JOIN late USING (seq)) {sql_hours('seen')}")
def stream_tumble_batches(spark, sf_dir):
    """The same where half of the rows arrive after the others: all but the late ones count."""
    df = readings(spark, sf_dir)
    out, log = scratch_path(spark, "tumble-two"), scratch_path(spark, "tumble-two-log")
    in_two_batches(
        spark, df.filter("seq % 2 = 0"), df.filter("seq % 2 = 1"), "tumble-halves",
        lambda stream: live.tumble_to_table(stream, "1h", out, log, columns=["m0", "m1"], compact_every=2),
    )
    return round_all(live.read_tumbled(spark, out).withColumnRenamed("ts", "bucket"))


@QUERIES.add(f"WITH {HALVES} SELECT * FROM late")
def stream_late(spark, sf_dir):
    """The rows that came too late for their hour."""
    df = readings(spark, sf_dir)
    out, log = scratch_path(spark, "late"), scratch_path(spark, "late-log")
    in_two_batches(
        spark, df.filter("seq % 2 = 0"), df.filter("seq % 2 = 1"), "late-halves",
        lambda stream: live.late_to_table(stream, "1h", out, log),
    )
    return live.read_late(spark, out).select(df.columns)


@QUERIES.add(f'WITH {COARSE} SELECT DISTINCT experience, device_id, "domain", "day", ts FROM coarse')
def stream_dedup(spark, sf_dir):
    """One row per device and time. Which copy arrives first is open, so values are left out."""
    stream = as_stream(coarse(spark, sf_dir), "dedup-in")
    out = run(spark, live.stream_dedup(stream), "dedup-out")
    return out.select("experience", "device_id", "domain", "day", "ts")


@QUERIES.add(
    f"""WITH {COARSE}, b AS (SELECT *, 0 AS age FROM coarse WHERE m0 >= 30 UNION ALL SELECT * REPLACE (-m0 AS m0), 1 FROM coarse)
    SELECT * EXCLUDE (age) FROM b QUALIFY row_number() OVER (PARTITION BY {K}, ts ORDER BY age, seq) = 1"""
)
def stream_upsert(spark, sf_dir):
    """Two streams into one table, a compaction between them and a batch sent twice; rows already there win."""
    df = coarse(spark, sf_dir)
    path = scratch_path(spark, "upsert")
    for label, part in (("first", df.filter("m0 >= 30")), ("second", df)):
        query = live.stream_upsert(as_stream(part, label), path, scratch_path(spark, f"{label}-log"))
        query.awaitTermination()
        batches.append_batch(df.withColumn("m0", -F.col("m0")), path, "again", 0)
        batches.compact(spark, path)
        batches.append_batch(df.withColumn("m0", -F.col("m0")), path, "again", 0)
    return live.read_upserts(spark, path).select(df.columns)


@QUERIES.add(
    f"""WITH {READINGS} SELECT experience, device_id, 'bio_signal' AS "domain", "day", ts, CAST(NULL AS DOUBLE) AS m0, m1 FROM readings
    UNION ALL SELECT experience, device_id, 'environment', "day", ts, m0, NULL FROM readings"""
)
def stream_parse(spark, sf_dir):
    """Raw lines parsed as streams, one for each of two domains."""
    stream = as_stream(kv_lines(spark, sf_dir).select("value", "source_file"), "lines-in")
    tables = live.stream_parse(stream, DOMAINS, ["m0", "m1"])
    parts = [run(spark, table, f"lines-{domain}") for domain, table in sorted(tables.items())]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.select("experience", "device_id", "domain", "day", "ts", "m0", "m1")
