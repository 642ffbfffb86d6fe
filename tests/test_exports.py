import pytest
from helpers import at
from pyspark.sql import functions as F

from tidegrid.operators import columns as C
from tidegrid.operators import merge as M
from tidegrid.sinks import exports as X


# device, first row, seconds between rows, readings of m0
SERIES = (
    ("pump7", (0, 21, 30), 60, (3.25, 3.5, 4.5)),
    ("pump7", (1, 22, 59), 60, (-1.0, None, 2.5, 8.0)),
    ("Valve 2", (0, 23, 15), 60, (10.5, 11.5)),
    ("Valve 2", (2, 4, 0), 60, (0.5, 1.5, 2.5, 3.5, 4.5)),
)


def aggregated(spark, label="1min"):
    """Minute rows of two devices over three days, some of them late in the evening."""
    data = []
    for device, (day, hour, minute), gap, values in SERIES:
        for i, value in enumerate(values):
            t = at(day * 86_400 + hour * 3600 + minute * 60 + i * gap)
            data.append(("PLANT", device, "bio_signal", label, t.date(), t, value, 100.0 * day + i))
    return spark.createDataFrame(
        data,
        "experience string, device_id string, domain string, window string, day date, ts timestamp,"
        " m0__raw__mean double, m1__raw__mean double",
    )


COLUMNS = {"m0__raw__mean": {"name": "c0", "dtype": "int"}, "m1__raw__mean": "c1", "zz": "c2"}


def test_csv_rows_order_time_zone_and_rounding(spark):
    got = X.export_rows(aggregated(spark), COLUMNS, tz="Europe/Paris", window="1min", domain="bio_signal")
    assert got.columns == ["device_id", "Time", "c0", "c1"]
    rows = [tuple(r) for r in got.filter("device_id = 'pump7'").orderBy("Time").collect()]
    assert rows[:3] == [
        ("pump7", "2026-01-20 22:30:00", 3, 0.0), ("pump7", "2026-01-20 22:31:00", 4, 1.0),
        ("pump7", "2026-01-20 22:32:00", 4, 2.0),
    ]
    assert rows[3][1:] == ("2026-01-21 23:59:00", -1, 100.0) and rows[4][1:3] == ("2026-01-22 00:00:00", None)
    with pytest.raises(ValueError, match="none of the requested"):
        X.export_rows(aggregated(spark), {"zz": "a"})


def test_csv_range_is_half_open(spark):
    got = X.export_rows(aggregated(spark), COLUMNS, start="2026-01-20T21:31:00Z", end="2026-01-20T23:16:00Z")
    assert sorted(r.Time[11:] for r in got.collect()) == ["21:31:00", "21:32:00", "23:15:00"]


def exported(spark, path, window, like):
    return {(r.device_id, r.Time): (r.c0, r.c1) for r in X.read_csv_export(spark, path, like, window).collect()}


def test_csv_exports_side_by_side(spark, tmp_path):
    """Other windows, other devices and untouched days stay; columns are read by name."""
    path = str(tmp_path / "csv")
    minute, hour = aggregated(spark), aggregated(spark, "1h")
    like = X.export_rows(minute, COLUMNS)
    spans = {r.device_id: (r.first_date, r.last_date, r.rows) for r in X.export_csv(minute, path, COLUMNS, window="1min").collect()}
    assert spans == {"pump7": ("2026-01-20", "2026-01-21", 7), "Valve 2": ("2026-01-20", "2026-01-22", 7)}
    before = exported(spark, path, "1min", like)
    X.export_csv(hour.filter("device_id = 'pump7'"), path, COLUMNS, window="1h")
    assert exported(spark, path, "1min", like) == before
    # One device anew, with one day less: its older day goes, the other device stays.
    X.export_csv(minute.filter("device_id = 'pump7' and day = '2026-01-20'"), path, COLUMNS, window="1min")
    after = exported(spark, path, "1min", like)
    assert after == {k: v for k, v in before.items() if k[0] != "pump7" or k[1] < "2026-01-21"}
    # A window again, from rows that lack m0: c0 is empty there, c1 keeps its place.
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "csv").rglob("local_day=2026-01-20/*.csv")}
    window = {"start": "2026-01-22", "end": "2026-01-22T04:02:00"}
    X.export_csv(
        minute.drop("m0__raw__mean").withColumn("m1__raw__mean", F.lit(-1.0)), path, COLUMNS, window="1min",
        **window, run_from=window["start"], run_to=window["end"],
    )
    again = exported(spark, path, "1min", like)
    late = {k for k in after if "2026-01-22 00:00:00" <= k[1] < "2026-01-22 04:02:00"}
    assert len(late) == 2 and again == {k: ((None, -1.0) if k in late else v) for k, v in after.items()}
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "csv").rglob("local_day=2026-01-20/*.csv")}
    # A window that is empty now takes its rows away.
    X.export_csv(minute.filter("false"), path, COLUMNS, window="1min", run_from="2026-01-22", run_to="2026-01-23")
    assert exported(spark, path, "1min", like) == {k: v for k, v in again.items() if k[1] < "2026-01-22"}
    # A column that was never there is added to all files.
    X.export_csv(
        minute.withColumn("zz", F.lit(7.0)), path, COLUMNS, window="1min", start="2026-01-20", end="2026-01-20T21:31:00",
        run_from="2026-01-20", run_to="2026-01-20T21:31:00",
    )
    wide = X.read_csv_export(spark, path, X.export_rows(minute.withColumn("zz", F.lit(7.0)), COLUMNS), "1min")
    assert {(r.c1, r.c2) for r in wide.filter("c2 is not null").collect()} == {(0.0, 7.0)} and wide.count() == 5


def test_parquet_export_selects_renames_and_keeps_labels(spark, tmp_path):
    path = str(tmp_path / "pq")
    numbered = aggregated(spark).withColumn("device_id", F.when(F.col("device_id") == "pump7", "007").otherwise("1d"))
    X.export_parquet(numbered, path, {"m1__raw__mean": "b"}, window="1min")
    X.export_parquet(numbered.filter("device_id = '007'").limit(2), path, {"m1__raw__mean": "b"}, window="1min")
    got = X.read_parquet_export(spark, path, "1min")
    assert set(got.columns) == {"ts", "b", "device_id"}
    assert {r.device_id: r["count"] for r in got.groupBy("device_id").count().collect()} == {"007": 2, "1d": 7}


def test_long_tables_join_domains_and_pad_devices(spark, tmp_path):
    df = aggregated(spark)
    env = df.filter("device_id = 'pump7'").select(
        "experience", "device_id", F.lit("environment").alias("domain"), "window", "day", "ts",
        F.lit(18.0).alias("outdoor_temp__raw__mean"),
    )
    both = df.unionByName(env, allowMissingColumns=True)
    tables = X.export_long(both, str(tmp_path), ["1min", "1h"], metadata={"pump7": {"name": "left", "notes": "n"}})
    assert set(tables) == {"data_1min", "devices"} and "/plant/" in tables["data_1min"]
    got = spark.read.parquet(tables["data_1min"])
    assert got.columns[:2] == ["ts", "device_id"] and got.count() == 14
    assert got.filter("outdoor_temp__raw__mean is null").select("device_id").distinct().count() == 1
    tables = X.export_long(both, str(tmp_path), ["1min"], metadata={"pump7": {"name": "right"}})
    device = spark.read.parquet(tables["devices"]).filter("device_id = 'pump7'").first()
    assert (device.name, device.notes) == ("right", "n")


def test_wide_pivot(spark):
    got = M.pivot_wide(aggregated(spark), by=("day", "ts"))
    assert got.columns[2:] == [f"{d}__m{i}__raw__mean" for d in ("Valve_2", "pump7") for i in (0, 1)]
    assert got.count() == 14


def test_wide_pivot_refuses_two_values_for_a_cell(spark):
    df = aggregated(spark)
    other = df.withColumn("m0__raw__mean", F.lit(0.0)).withColumn("domain", F.lit("environment"))
    with pytest.raises(Exception, match="two values for"):
        M.pivot_wide(df.unionByName(other)).collect()


def test_wide_export_replaces_ranges_and_adds_columns(spark, tmp_path):
    df, path = aggregated(spark), str(tmp_path)
    one = [{"domain": "bio_signal", "sensors": ["m0"]}]
    tables = X.export_wide(df, path, one, devices=["pump7"])
    assert set(tables) == {"PLANT__AGGREGATED__1MIN"}
    target = tables["PLANT__AGGREGATED__1MIN"]
    day = df.filter("day = '2026-01-21' and device_id = 'pump7'").withColumn("m0__raw__mean", F.lit(-1.0))
    X.export_wide(day, path, [{"domain": "bio_signal"}], devices=["pump7", "Valve 2"])
    got = spark.read.option("mergeSchema", "true").parquet(target)
    assert got.count() == 7 and got.filter("`pump7__m0__raw__mean` = -1").count() == 4
    assert "Valve_2__m1__raw__mean" in got.columns


def test_source_entries(spark):
    df = aggregated(spark)
    got = C.select_source(df, [{"domain": "bio_signal", "devices": ["pump7"], "metrics": ["std"]}, {"domain": "x"}])
    assert got.count() == 7
    assert C.select_source(df, [{"domain": "other"}]).count() == 0


def test_database_types():
    assert X.database_type("bigint") == "BIGINT"
    assert X.database_type("timestamp") == "TIMESTAMPTZ"
    assert X.database_type("string") == "TEXT"


def test_merge_replace_without_window_replaces_all(spark):
    df = aggregated(spark)
    assert M.merge_replace_window(df, df.limit(1)).count() == 1


def test_wide_append_keeps_one_row_per_time(spark, tmp_path):
    df, path = aggregated(spark), str(tmp_path)
    one = [{"domain": "bio_signal", "sensors": ["m0"]}]
    first = df.filter("day < '2026-01-22'")
    target = X.export_wide(first, path, one, devices=["pump7"])["PLANT__AGGREGATED__1MIN"]
    X.export_wide(df.withColumn("m0__raw__mean", F.lit(-5.0)), path, one, devices=["pump7", "Valve 2"], mode="append")
    got = spark.read.option("mergeSchema", "true").parquet(target)
    assert got.count() == got.select("ts").distinct().count() == 14
    # Values already there stay; the empty reading and the new device are filled.
    assert got.filter("pump7__m0__raw__mean = -5").count() == 1
    assert got.filter("Valve_2__m0__raw__mean = -5").count() == 7
