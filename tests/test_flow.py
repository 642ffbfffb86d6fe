from datetime import datetime, timedelta, timezone

import pytest
from helpers import at, frame, rows, to_pandas
from pyspark.sql import functions as F

from tidegrid.operators import columns as C
from tidegrid.plans import flow as FL
from tidegrid.plans import history as H
from tidegrid.plans.flow import FlowStep
from tidegrid.sources.events import read_run_events
from tidegrid.sources.stage import read_stage
from tidegrid.streaming import live


def raw_folder(tmp_path, days=2):
    folder = tmp_path / "raw"
    folder.mkdir()
    for d in range(days):
        day = (at(0) + timedelta(days=d)).strftime("%Y-%m-%d")
        for device in ("valve01", "valve02"):
            lines = [
                f"{day}T{h:02d}:00:{s:02d}.000000Z;m0:{100 + (s * 7) % 50};m1:{300 if s != 30 else 790};outdoor_temp:{18 + s / 10}"
                for h in (1, 13)
                for s in range(60)
                if s not in (20, 21)
            ]
            lines.insert(5, lines[4])
            (folder / f"DEMO_{device}_{day}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def steps(root):
    return [
        FlowStep("parse", output=f"{root}/10"),
        FlowStep("clean", output=f"{root}/20"),
        FlowStep("resample", output=f"{root}/25"),
        FlowStep("transform"),
        FlowStep("normalize", {"fit": True, "params_path": f"{root}/fit"}),
        FlowStep("aggregate", {"windows": ["60s", "1h"]}, output=f"{root}/40"),
    ]


def test_full_flow_then_slices_and_reruns(spark, tmp_path):
    source, root = raw_folder(tmp_path), str(tmp_path / "data")
    done = FL.run_flow(steps(root), spark=spark, source=source, events_path=f"{root}/log", flow="demo", run_id="r1")
    full = to_pandas(C.stack_domains(done), ("device_id", "domain", "window", "ts"))
    cleaned = read_stage(spark, f"{root}/20", domain="bio_signal")
    assert cleaned.count() == 2 * 2 * 2 * 58
    assert cleaned.filter("m1 is null").count() == 8
    assert "m1__cbrt_inv__mean" in full.columns

    later = FL.run_flow(steps(root), spark=spark, first="transform")
    again = to_pandas(C.stack_domains(later), ("device_id", "domain", "window", "ts"))
    assert again.equals(full[again.columns])

    # A window of one day again, through the stored stages: nothing changes.
    FL.reprocess(steps(root)[:3], at(0), at(86_400), spark=spark, source=source)
    later = FL.run_flow(steps(root), spark=spark, first="transform", only=None)
    again = to_pandas(C.stack_domains(later), ("device_id", "domain", "window", "ts"))
    assert again.equals(full[again.columns])

    events = read_run_events(spark, f"{root}/log")
    counts = {r.status: r["count"] for r in events.groupBy("status").count().collect()}
    assert counts == {"start": 6, "planned": 2, "success": 6}
    n_steps = spark.createDataFrame([("demo", 6)], ["flow", "n_steps"])
    assert H.run_status(events, "r1", n_steps).first().status == "success"


def test_lazy_chain_uses_one_exchange_of_rows(spark):
    df = frame(spark, rows([(i, i % 7, float(i)) for i in range(50)]))
    flow = [FlowStep("clean"), FlowStep("resample"), FlowStep("aggregate", {"windows": ["10s"]})]
    out = FL.run_flow(flow, {"bio_signal": df}, params={"split": False})["bio_signal"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parameters(spark):
    clean = FL.REGISTRY["clean"]
    with pytest.raises(ValueError, match="no parameter"):
        FL.resolve_params(clean, {"speed": 1})
    with pytest.raises(TypeError, match="drop_duplicates"):
        FL.resolve_params(clean, {"drop_duplicates": "yes"})
    merged = FL.resolve_params(clean, {"drop_duplicates": False}, {"drop_duplicates": True})
    assert merged["drop_duplicates"] is True
    flow = [FlowStep("clean"), FlowStep("aggregate")]
    assert FL.shared_params(flow, {"decimals": 2}) == [{}, {"decimals": 2}]
    with pytest.raises(ValueError, match="no step"):
        FL.shared_params(flow, {"speed": 2})


def test_selecting_steps():
    flow = [FlowStep("parse"), FlowStep("clean", name="first"), FlowStep("clean", name="second"), FlowStep("aggregate")]
    assert FL.step_range(flow, first="first", last="second") == range(1, 3)
    assert FL.step_range(flow, only="aggregate") == range(3, 4)
    assert FL.step_range(flow) == range(4)
    with pytest.raises(ValueError, match="not in flow"):
        FL.step_range(flow, only="clean")
    with pytest.raises(ValueError, match="several steps"):
        FL.step_range([FlowStep("clean"), FlowStep("clean")], first="clean")


def test_errors_are_logged_and_raised(spark, tmp_path):
    @FL.custom_step("boom")
    def boom(df):
        raise RuntimeError("went wrong")

    log = str(tmp_path / "log")
    with pytest.raises(RuntimeError):
        FL.run_flow([FlowStep("boom")], {"d": frame(spark, rows([(0, 1, 1.0)]))}, spark=spark, events_path=log, run_id="x")
    got = read_run_events(spark, log).filter("status = 'error'").first()
    assert got.error == "went wrong"
    with pytest.raises(ValueError, match="start must not be after end"):
        FL.run_flow([FlowStep("clean")], {}, start="2026-01-02", end="2026-01-01")


def test_fit_needs_a_saved_fit(spark, tmp_path):
    df = frame(spark, rows([(0, 1, 1.0)]))
    with pytest.raises(FileNotFoundError):
        FL.run_flow([FlowStep("normalize", {"params_path": str(tmp_path / "no")})], {"bio_signal": df})


def test_history(spark, tmp_path):
    path = str(tmp_path / "log")
    old = datetime(2025, 1, 1, tzinfo=timezone.utc)
    H.log_event(spark, path, "clean", "start", run_id="a", flow="f", params={"password": "s3", "x": 1}, ts=old)
    H.log_event(spark, path, "clean", "error", run_id="b", flow="f", error="no", duration_ms=1.26)
    events = read_run_events(spark, path)
    assert events.filter("run_id = 'a'").first().params == {"password": "***", "x": "1"}
    assert events.filter("run_id = 'b'").first().duration_ms == 1.3
    latest = H.latest_run_per_flow(H.run_summaries(events)).collect()
    assert [(r.flow, r.run_id, r.status) for r in latest] == [("f", "b", "error")]
    assert H.recent_runs(H.run_summaries(events), 1).first().run_id == "b"
    assert H.events_for_run(events, "a", "other").count() == 0
    assert [r.run_id for r in H.prune_events(events, datetime.now(timezone.utc)).collect()] == ["b"]


def test_stage_status(spark, tmp_path):
    (tmp_path / "20").mkdir()
    (tmp_path / "20" / "a.parquet").write_text("x")
    (tmp_path / "20" / "params.json").write_text("{}")
    stages = {"20": str(tmp_path / "20"), "30": str(tmp_path / "30")}
    got = {r.stage: (r.n_files, r.dataset_status) for r in H.stage_status(spark, stages).collect()}
    assert got == {"20": (1, "incomplete"), "30": (0, "incomplete")}
    assert H.stage_status(spark, stages, ["30"]).first().dataset_status == "up-to-date"


def test_stream_over_several_batches(spark, tmp_path):
    """Files come one per batch; a row later than the watermark is dropped."""
    source = str(tmp_path / "in")
    schema = "experience string, device_id string, domain string, ts timestamp, m0 double"
    base = [("E", "d", "bio_signal", at(h * 3600 + m * 60), float(h)) for h in range(6) for m in (0, 30)]
    for part in (base[:6], base[6:], [("E", "d", "bio_signal", at(60), 99.0)], [("E", "d", "bio_signal", at(9 * 3600), 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        tumbled = live.stream_tumble(stream, "1h", ["mean", "count"], columns=["m0"])
        live.run_to_table(tumbled, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.m0__raw__mean, r.m0__raw__count) for r in got] == [(float(h), 2) for h in range(6)]


def test_stream_dedup_keeps_one_row(spark, tmp_path):
    source = str(tmp_path / "in")
    df = frame(spark, rows([(0, 1, 1.0), (0, 2, 2.0), (5, 3, 3.0)]))
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        live.run_to_table(live.stream_dedup(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_repeated_steps_keep_their_parameters(spark):
    df = frame(spark, rows([(0, 4, 1.0)]))

    def step(function):
        return FlowStep("transform", {"transforms": [{"function": function, "target": {"columns": ["m0"]}}]})

    out = FL.run_flow([step("sqrt_inv"), step("identity")], {"bio_signal": df})["bio_signal"].first()
    assert (out.m0__sqrt_inv, out.m0__identity) == (0.5, 4.0)


def test_windowed_run_reads_few_files_and_skips_without_any(spark, tmp_path):
    source, log = raw_folder(tmp_path, days=5), str(tmp_path / "log")
    run = {"spark": spark, "source": source, "events_path": log}
    out = FL.run_flow([FlowStep("parse")], **run, run_id="a", start=at(3 * 86_400), end=at(4 * 86_400))["bio_signal"]
    assert {r.source_file[-14:-4] for r in out.select("source_file").distinct().collect()} == {"2026-01-23"}
    scan = out._jdf.queryExecution().executedPlan()
    out.collect()
    assert "_metadata" in scan.toString() or "file_name" in scan.toString()
    assert FL.run_flow([FlowStep("parse")], **run, run_id="b", start="2027-01-01", end="2027-01-02") == {}
    events = read_run_events(spark, log)
    assert {r.status for r in events.filter("run_id = 'b'").collect()} == {"start", "skip"}


def test_a_lazy_step_that_fails_is_no_success(spark, tmp_path):
    @FL.custom_step("late_boom")
    def late_boom(df):
        return df.withColumn("m0", F.raise_error(F.lit("too late")).cast("bigint"))

    log = str(tmp_path / "log")
    flow = [FlowStep("late_boom"), FlowStep("clean", output=str(tmp_path / "20"))]
    with pytest.raises(Exception, match="too late"):
        FL.run_flow(flow, {"bio_signal": frame(spark, rows([(0, 1, 1.0)]))}, spark=spark, events_path=log, run_id="x")
    got = sorted((r.treatment, r.status) for r in read_run_events(spark, log).collect())
    assert got == [("clean", "error"), ("clean", "start"), ("late_boom", "planned"), ("late_boom", "start")]


def test_own_empty_columns_stay(spark, tmp_path):
    both = frame(spark, rows([(0, None, 1.0)])).withColumn("outdoor_temp", F.lit(None).cast("double"))
    env = both.withColumn("domain", F.lit("environment")).withColumn("outdoor_temp", F.lit(3.0))
    path = str(tmp_path / "20")
    from tidegrid.sinks.stage import write_stage

    write_stage(both.unionByName(env), path)
    flow = [FlowStep("clean", output=path), FlowStep("transform", {"transforms": []})]
    tables = FL.run_flow(flow, spark=spark, first="transform")
    assert {"m0", "m1"} <= set(tables["bio_signal"].columns) and "outdoor_temp" not in tables["bio_signal"].columns
    assert "outdoor_temp" in tables["environment"].columns and "m0" not in tables["environment"].columns
