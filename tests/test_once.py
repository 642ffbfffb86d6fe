"""Lines are parsed once, however often their rows are looked at."""

from __future__ import annotations

from helpers import at, frame, rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegrid.operators.columns import range_filter
from tidegrid.plans.flow import FlowStep, run_flow
from tidegrid.sources import raw


def test_filters_on_time_do_not_repeat_the_parsing(spark):
    lines = spark.createDataFrame([("2026-01-20T00:00:01Z;m0:5", "E_d_2026-01-20.csv", 1)], "value string, source_file string, seq long")
    parsed = raw.source_metadata(raw.parse_kv_lines(lines))
    table = raw.type_domains(parsed, {"bio_signal": {"prefix": "m", "dtype": "int"}}, ["m0"])["bio_signal"]
    table = range_filter(table, at(0), at(3600))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    for part in ("translate(", "replace(trim", "regexp_replace(", "regexp_extract("):
        assert plan.count(part) == 1, part
    row = table.first()
    assert (row.experience, row.device_id, row.ts.second, row.m0) == ("E", "d", 1, 5)


def test_a_flow_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(device):
        seen.add(1)
        return device

    df = frame(spark, rows([(i, i % 7, float(i)) for i in range(50)]))
    df = df.withColumn("device_id", F.udf(look, StringType())("device_id"))
    flow = [FlowStep("clean"), FlowStep("aggregate", {"windows": ["10s"], "metrics": ["count"]})]
    assert run_flow(flow, {"bio_signal": df})["bio_signal"].count() == 5
    assert seen.value == 50
