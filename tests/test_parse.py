import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as S
from tidegrid.sources import raw

DOMAINS = {
    "bio_signal": {"prefix": "m", "dtype": "int"},
    "environment": {"columns": ["outdoor_temp"], "dtype": "float"},
}


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def parse(spark, folder, **options):
    return raw.parse_raw(spark, folder, DOMAINS, **options)


def test_types_days_and_metadata(spark, tmp_path):
    path = write(
        tmp_path / "raw",
        "MY_EXP_gauge.4_2026-01-20.csv",
        "2026-01-20T23:59:59.900000Z;m0:10;m10:3.0;m2:3.7;outdoor_temp:18.94\n"
        "2026-01-21T00:00:01Z;m0:hello;outdoor_temp:broken\n",
    )
    tables = parse(spark, path, substitutions=[{"src": "MY_EXP", "target": "MY-EXP"}])
    bio = tables["bio_signal"].orderBy("ts")
    assert [c for c in bio.columns if c.startswith("m")] == ["m0", "m2", "m10"]
    first, second = bio.collect()
    assert (first.m0, first.m2, first.m10) == (10, None, 3)
    assert (second.m0, str(first.day), str(second.day)) == (None, "2026-01-20", "2026-01-21")
    assert (first.experience, first.device_id) == ("MY-EXP", "gauge.4")
    temps = [r.outdoor_temp for r in tables["environment"].orderBy("ts").collect()]
    assert temps == [18.94, None]


def test_dirty_lines(spark, tmp_path):
    path = write(
        tmp_path / "raw",
        "E_d_2026-01-20.csv",
        "\n   \n2026-01-20T09:00:00Z;junk;nothing\n2026-01-20T09:00:01Z;m0:1;m0:2\n"
        "2026-01-20T09:00:02Z;m\x000:3 \t\n2026-01-20T09:00:03Z;note:a:b;m0:1d\n"
        "2026-01-20T09:00:04Z;ts:1999-01-01;m0:4\n",
    )
    got = parse(spark, path, keys=["m0"])["bio_signal"].orderBy("ts").collect()
    assert [r.m0 for r in got] == [2, 3, None, 4]
    assert [r.ts.second for r in got] == [1, 2, 3, 4]


def test_value_with_colon_is_split_once(spark):
    lines = spark.createDataFrame([("2026-01-20T09:00:00Z;note:a:b;m0:1",)], ["value"])
    parsed = raw.parse_kv_lines(lines)
    assert parsed.select(raw.value_of("note").alias("v")).first().v == "a:b"
    assert raw.discover_keys(parsed) == ["m0", "note"]


def test_malformed_time_and_missing_date_raise(spark):
    bad = spark.createDataFrame([("yesterday;m0:1",)], ["value"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|yesterday"):
        raw.parse_kv_lines(bad).select("ts").collect()
    name = spark.createDataFrame([("EXP_dev.csv",)], ["source_file"])
    with pytest.raises(Exception, match="no date in file name"):
        raw.source_metadata(name).select("device_id").collect()


def test_names_without_experience(spark):
    df = spark.createDataFrame([("gauge.4_2026-01-20.csv",), ("A_B_c_2026-01-20_x.csv",)], ["source_file"])
    got = {(r.experience, r.device_id) for r in raw.source_metadata(df).collect()}
    assert got == {("", "gauge.4"), ("A_B", "c")}


@pytest.mark.parametrize(
    "text, whole, number",
    [
        ("3.0", 3, 3.0), ("3.7", None, 3.7), (" 4 ", 4, 4.0), ("1e2", 100, 100.0), ("1d", None, None),
        ("1.0f", None, None), ("1_000", None, None), ("N/A", None, None), ("-.5", None, -0.5),
        ("inf", None, float("inf")), ("-Infinity", None, float("-inf")), ("", None, None), ("nan", None, None),
    ],
)
def test_numbers(spark, text, whole, number):
    row = spark.createDataFrame([(text,)], ["t"]).select(
        S.coerce_int(F.col("t")).alias("i"), S.coerce_float(F.col("t")).alias("f")
    ).first()
    assert (row.i, row.f) == (whole, number)


def test_other_time_zone(spark):
    df = spark.createDataFrame([("2026-01-20 10:00:00",), ("2026-01-20T10:00:00Z",)], ["t"])
    got = [r.h for r in df.select(F.hour(S.parse_ts(F.col("t"), "Europe/Paris")).alias("h")).collect()]
    assert got == [9, 10]


def test_one_pass_shape_equals_tables(spark, tmp_path):
    path = write(tmp_path / "raw", "E_d_2026-01-20.csv", "2026-01-20T09:00:00Z;m0:1;outdoor_temp:2.5\n")
    parsed = raw.parse_kv_lines(raw.source_metadata(raw.read_lines(spark, path)))
    got = {(r.domain, r.m0, r.outdoor_temp) for r in raw.type_rows(parsed, DOMAINS).collect()}
    assert got == {("bio_signal", 1, None), ("environment", None, 2.5)}


def test_values_are_found_as_whole_fields(spark):
    lines = ["2026-01-20T00:00:00;;;m:1;;m:2;;xm:3;;n:a:b;;:e;; m:9;;o", "2026-01-20T00:00:01;;m\0:4;;n:"]
    parsed = raw.parse_kv_lines(spark.createDataFrame([(x,) for x in lines], "value string"), ";;")
    keys = ["m", ";m", "n", "", "o", "n:a"]
    rows = parsed.select(*[raw.value_of(k).alias(f"c{i}") for i, k in enumerate(keys)]).collect()
    # Delimiters are taken from the left, so the first field of the first line is ";m".
    assert [tuple(r) for r in rows] == [("2", "1", "a:b", "e", None, None), ("4", None, "", None, None, None)]
    assert raw.discover_keys(parsed) == sorted(["", " m", ";m", "m", "n", "xm"])
