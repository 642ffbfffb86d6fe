import re

import pytest
from helpers import assert_close, at, frame, rows, to_pandas
from pyspark.sql import functions as F

from tidegrid.operators.columns import range_filter
from tidegrid.sinks.stage import write_stage
from tidegrid.sources.stage import read_file_stage, read_stage


def days(spark, factor=1):
    return frame(spark, rows([(d * 86_400 + h * 3600, factor * (d * 24 + h), 1.0) for d in range(3) for h in range(24)]))


def test_window_replace_keeps_the_rest_of_the_day(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    start, end = at(86_400 + 6 * 3600), at(86_400 + 8 * 3600)
    again = range_filter(days(spark, -1), start, end)
    for _ in range(2):  # running it twice changes nothing
        write_stage(again, path, "replace", start, end)
        got = to_pandas(read_stage(spark, path))
        assert_close(got.m0, [-v if 30 <= v < 32 else v for v in range(72)])


def test_window_ending_at_midnight_leaves_the_next_day(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    write_stage(range_filter(days(spark, -1), at(0), at(86_400)), path, "replace", at(0), at(86_400))
    got = to_pandas(read_stage(spark, path))
    assert_close(got.m0, [-v if v < 24 else v for v in range(72)])


def test_window_without_rows_empties_it(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    nothing = days(spark).filter("m0 < 0")
    write_stage(nothing, path, "replace", at(86_400), at(2 * 86_400))
    assert read_stage(spark, path).count() == 48
    assert len(list((tmp_path / "stage" / "domain=bio_signal").glob("day=*"))) == 2


def test_append_keeps_existing_rows(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = frame(spark, rows([(0, 1, 1.0), (1, 2, 1.0)]))
    more = frame(spark, rows([(1, 99, 9.0), (2, 3, 9.0)]))
    for df in (first, more, more):
        write_stage(df, path, "append")
        path_rows = to_pandas(read_stage(spark, path))
    assert_close(path_rows.m0, [1, 2, 3])


def test_reset_and_unknown_mode(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    write_stage(days(spark).filter("m0 = 5"), path, "reset", at(0), at(1))
    assert read_stage(spark, path).count() == 1
    with pytest.raises(ValueError, match="output mode"):
        write_stage(days(spark), path, "merge")


def test_reading_prunes_partitions_and_columns(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    df = read_stage(spark, path, at(86_400), at(86_400), "bio_signal").select("ts", "m0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "day#" in filters and "domain#" in filters
    assert "ReadSchema: struct<ts:timestamp,m0:bigint>" in plan
    assert df.count() == 24


def test_drifting_columns_merge(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(days(spark), path)
    late = rows([(4 * 86_400, 1, 1.0)])
    write_stage(frame(spark, late).withColumn("m2", F.lit(7).cast("long")), path, "append")
    got = read_stage(spark, path)
    assert got.filter("m2 = 7").count() == 1 and got.count() == 73


def test_files_named_by_device_and_day(spark, tmp_path):
    root = tmp_path / "files"
    folder = root / "domain=bio_signal"
    folder.mkdir(parents=True)
    data = frame(spark, rows([(0, 1, 1.0)])).select("ts", "m0").toPandas()
    data.to_parquet(folder / "EXP__gauge.4__clean__2026-01-20.parquet", index=False)
    data.to_parquet(folder / "EXP__gauge.4__aggregated__60s__2026-01-21.parquet", index=False)
    data.to_parquet(root / "stray.parquet", index=False)
    got = read_file_stage(spark, str(root)).orderBy("day").collect()
    assert got[0].ts == at(0).replace(tzinfo=None)
    assert [(r.step, r.window, str(r.day), r.domain, r.m0) for r in got] == [
        ("clean", None, "2026-01-20", "bio_signal", 1),
        ("aggregated", "60s", "2026-01-21", "bio_signal", 1),
    ]
    data.to_parquet(folder / "EXP__clean__2026-01-20.parquet", index=False)
    with pytest.raises(Exception, match="4 or 5 parts"):
        read_file_stage(spark, str(root)).select("experience").collect()


def test_no_scratch_copy_stays(spark, tmp_path):
    from pathlib import Path

    from tidegrid.session import clear_scratch, cut_lineage, scratch_root

    clear_scratch(spark)
    path = str(tmp_path / "stage")
    for mode, window in (("replace", ()), ("replace", (at(0), at(3600))), ("append", ())):
        write_stage(days(spark), path, mode, *window)
    left = set(Path(scratch_root(spark)).glob("stage-*")) | set(Path(scratch_root(spark)).glob("touched-*"))
    assert not left
    kept = cut_lineage(days(spark), "kept")
    assert kept.count() and list(Path(scratch_root(spark)).glob("kept-*"))
    clear_scratch(spark)
    assert not list(Path(scratch_root(spark)).glob("kept-*"))


def test_labels_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = days(spark).withColumn("domain", F.lit("01")).withColumn("window", F.lit("1d"))
    write_stage(df, path)
    write_stage(range_filter(df, at(0), at(3600)), path, "replace", at(0), at(3600))
    got = read_stage(spark, path)
    assert {(r.domain, r.window) for r in got.collect()} == {("01", "1d")} and got.count() == 72
    assert [p.name for p in (tmp_path / "stage").glob("domain=*")] == ["domain=01"]


def test_append_prefers_new_results(spark, tmp_path):
    path = str(tmp_path / "stage")
    for m0 in (1, 2):
        write_stage(frame(spark, rows([(0, m0, 1.0), (0, m0, 1.0)])), path, "append", prefer="new")
    assert [r.m0 for r in read_stage(spark, path).collect()] == [2]


def test_null_labels_survive_every_mode(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = frame(spark, rows([(0, 1, 1.0), (3600, 2, 1.0), (7200, 3, 1.0)])).withColumn("window", F.lit(None).cast("string"))
    write_stage(df, path)
    write_stage(range_filter(df, at(0), at(3600)).withColumn("m0", F.lit(-1).cast("long")), path, "replace", at(0), at(3600))
    assert_close(to_pandas(read_stage(spark, path)).m0, [-1, 2, 3])
    more = df.filter("m0 = 3").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    for _ in range(2):
        write_stage(more, path, "append")
    assert_close(to_pandas(read_stage(spark, path)).m0, [-1, 2, 3, 3])
    write_stage(df.limit(0), path, "replace", at(0), at(3600))
    assert_close(to_pandas(read_stage(spark, path)).m0, [2, 3, 3])
