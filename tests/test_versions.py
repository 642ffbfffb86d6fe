import json

import pytest
from helpers import assert_close, at, frame, rows, to_pandas
from pyspark.sql import functions as F

from tidegrid.operators.columns import range_filter
from tidegrid.plans.flow import FlowStep, run_flow
from tidegrid.sinks import versions as V
from tidegrid.sources import versions as R
from tidegrid.sources.stage import read_stage


def days(spark, factor=1):
    return frame(spark, rows([(d * 86_400 + h * 3600, factor * (d * 24 + h), 1.0) for d in range(3) for h in range(24)]))


def values(spark, path, **options):
    return list(to_pandas(R.read_version(spark, path, **options), ("ts",)).m0)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "stage")
    V.write_version(days(spark), path)
    broken = days(spark, -1).withColumn("m0", F.when(F.col("m0") > -40, F.col("m0")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    for mode in ("replace", "reset", "append"):
        with pytest.raises(Exception, match="broken"):
            V.write_version(broken, path, mode, prefer="new")
        assert values(spark, path) == list(range(72))
    assert len(list((tmp_path / "stage" / "_versions").glob("0*.json"))) == 1


def test_of_two_writes_at_once_one_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stage")
    V.write_version(days(spark), path)
    before = R.manifest(spark, path)
    V.write_version(days(spark, -1), path)
    monkeypatch.setattr(V, "manifest", lambda *_: before)
    with pytest.raises(V.ConcurrentWrite):
        V.write_version(days(spark, 5), path)
    assert values(spark, path) == [-v for v in range(72)]
    assert len(list((tmp_path / "stage" / "data").iterdir())) == 2


def test_windows_replace_append_and_reset(spark, tmp_path):
    path = str(tmp_path / "stage")
    V.write_version(days(spark), path)
    start, end = at(86_400 + 6 * 3600), at(86_400 + 8 * 3600)
    for _ in range(2):
        V.write_version(range_filter(days(spark, -1), start, end), path, "replace", start, end)
        assert values(spark, path) == [-v if 30 <= v < 32 else v for v in range(72)]
    written = {e["write"] for e in R.manifest(spark, path)["entries"]}
    assert len(written) == 2  # the other days were not written again
    # A window that ends at midnight leaves the next day, one without rows empties its days.
    V.write_version(days(spark).filter("m0 < 0"), path, "replace", at(0), at(86_400))
    assert values(spark, path) == [-v if 30 <= v < 32 else v for v in range(24, 72)]
    assert values(spark, path, start=at(2 * 86_400)) == list(range(48, 72))
    more = frame(spark, rows([(86_400, 99, 9.0), (86_401, 98, 9.0)]))
    V.write_version(more, path, "append")
    V.write_version(more, path, "append", prefer="new")
    assert values(spark, path, start=at(86_400), end=at(2 * 86_400))[:3] == [99, 98, 25]
    assert values(spark, path, version=0) == list(range(72))
    V.write_version(days(spark).filter("m0 = 5"), path, "reset")
    assert values(spark, path) == [5]
    gone = V.drop_versions(spark, path, keep=1)
    assert gone == [0, 1, 2, 3, 4, 5] and values(spark, path) == [5]
    assert len(list((tmp_path / "stage" / "data").iterdir())) == 1
    with pytest.raises(ValueError, match="no version 0"):
        values(spark, path, version=0)
    with pytest.raises(ValueError, match="output mode"):
        V.write_version(days(spark), path, "merge")


def test_null_labels_are_partitions(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = days(spark).withColumn("window", F.when(F.col("m0") % 2 == 0, "1h")).withColumn("day", F.when(F.col("m0") < 48, F.col("day")))
    V.write_version(df, path)
    V.write_version(range_filter(df, at(0), at(3600)).withColumn("m0", F.lit(-1).cast("long")), path, "replace", at(0), at(3600))
    assert values(spark, path) == [-1, *range(1, 72)]
    V.write_version(df.filter("m0 = 70").withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 DAYS")), path, "append")
    assert values(spark, path) == [-1, *range(1, 72), 70]


def test_manifest_has_schema_and_key_sizes(spark, tmp_path):
    path = str(tmp_path / "stage")
    V.write_version(days(spark), path)
    wider = frame(spark, rows([(9 * 86_400, 1, 1.0)])).withColumn("m2", F.lit(2.5))
    V.write_version(wider, path, "append")
    assert read_stage(spark, path).columns[-1] == "m2"
    assert R.largest_key(spark, path) == 24 and R.largest_key(spark, path, start=at(9 * 86_400)) == 1
    assert R.largest_key(spark, str(tmp_path / "none")) is None
    assert R.stored_domains(spark, path) == ["bio_signal"]
    with pytest.raises(ValueError, match="m0"):
        V.write_version(days(spark).withColumn("m0", F.col("m0").cast("double")), path, "append")
    with pytest.raises(ValueError, match="lack"):
        V.write_version(days(spark).drop("day"), path, "append")
    text = (tmp_path / "stage" / "_versions" / "00000001.json").read_text()
    assert json.loads(text)["version"] == 1


def test_flows_write_versions_and_start_no_counting_job(spark, tmp_path):
    steps = [
        FlowStep("clean", {"domains": {"bio_signal": {"max_value": 60, "spike_window": 3, "spike_threshold": 1000.0}}}, output=str(tmp_path / "20")),
        FlowStep("aggregate", {"windows": ["1d"], "metrics": ["mean"]}, output=str(tmp_path / "40")),
    ]
    out = run_flow(steps, {"bio_signal": days(spark)}, spark=spark, versioned=True)["bio_signal"]
    assert_close(to_pandas(out).m0__raw__mean, [11.5, 35.5, 54.0])
    assert R.manifest(spark, str(tmp_path / "40"))["version"] == 0
    lazy = [*steps[:1], FlowStep("aggregate", {"windows": ["1d"], "metrics": ["mean"]})]
    context = spark.sparkContext
    context.setJobGroup("lazy-flow", "no job before an action")
    try:
        again = run_flow(lazy, spark=spark, first="aggregate")["bio_signal"]
        assert len(context.statusTracker().getJobIdsForGroup("lazy-flow")) == 0
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert_close(to_pandas(again).m0__raw__mean, [11.5, 35.5, 54.0])
