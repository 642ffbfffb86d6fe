"""Whole flows: parse to aggregate, slices of them, step windows, re-runs, custom steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import COARSE, K, Registry, coarse, round_all, sql_bucket, sql_r6
from tidegrid.catalog.grids import BOUNDED, DEDUP, sql_ffill, sql_grid, sql_spikes
from tidegrid.functions.scalars import once
from tidegrid.operators import columns as C
from tidegrid.plans.flow import FlowStep, custom_step, reprocess, run_flow
from tidegrid.session import scratch_path
from tidegrid.sources import raw

QUERIES = Registry()

DOMAINS = {
    "bio_signal": {"prefix": "m", "dtype": "int"},
    "environment": {"columns": ["outdoor_temp"], "dtype": "float"},
}
RULES = {"bio_signal": {"min_value": 1, "max_value": 300, "spike_window": 10, "spike_threshold": 40}}


def steps(root: str | None = None) -> list[FlowStep]:
    """Parse to aggregate; with ``root`` every stage is written under it."""

    def out(stage: str) -> str | None:
        return f"{root}/{stage}" if root else None

    return [
        FlowStep("parse", {"domains": DOMAINS, "keys": ["m1", "outdoor_temp"]}, output=out("10_parsed")),
        FlowStep("clean", {"domains": RULES}, output=out("20_clean")),
        FlowStep(
            "resample",
            {"freq": "10min", "unit": "10min", "max_gap_fill_s": 6},
            output=out("25_resampled"),
        ),
        FlowStep(
            "transform",
            {"transforms": [{"function": "sqrt_inv", "target": {"domain": "bio_signal"}}]},
            output=out("30_transform"),
        ),
        FlowStep(
            "normalize",
            {"fit": True, "columns": {"*__sqrt_inv": "*__sqrt_inv__norm"}},
            output=out("35_normalized"),
        ),
        FlowStep("aggregate", {"windows": ["1h", "6h"], "metrics": ["mean", "count"]}, output=out("40_aggregated")),
    ]


def lines(spark, sf_dir):
    """Raw lines made from the readings: ``m1`` a whole number, a temperature from the value."""
    r = coarse(spark, sf_dir)
    value = F.concat_ws(
        ";",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.concat(F.lit("m1:"), F.col("m1").cast("string")),
        F.concat(F.lit("outdoor_temp:"), F.col("m0").cast("string")),
    )
    name = F.concat_ws("_", "experience", "device_id", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(".csv")))
    made = r.select(once(value).alias("value"), "experience", "device_id", "day", "seq")
    return made.select("value", name.alias("source_file"), "seq")


def parsed(spark, sf_dir):
    return raw.type_domains(
        raw.source_metadata(raw.parse_kv_lines(lines(spark, sf_dir))), DOMAINS, ["m1", "outdoor_temp"]
    )


COLUMNS = ["m1__raw__mean", "m1__raw__count", "m1__sqrt_inv__mean", "m1__sqrt_inv__count",
           "m1__sqrt_inv__norm__mean", "m1__sqrt_inv__norm__count", "outdoor_temp__raw__mean", "outdoor_temp__raw__count"]


def stacked(tables):
    stage = C.stack_domains(tables)
    return round_all(stage.select("experience", "device_id", "domain", "day", "window", "ts", *COLUMNS))


def _sql_flow(where: str = "TRUE") -> str:
    """The chain in SQL. ``where`` limits the raw rows."""
    windows = []
    for label, seconds in (("1h", 3600), ("6h", 21600)):
        bio = ", ".join(
            f"{sql_r6(f'avg({c})')} AS {n}__mean, count({c}) AS {n}__count"
            for c, n in (("m1", "m1__raw"), ("inv", "m1__sqrt_inv"), ("norm", "m1__sqrt_inv__norm"))
        )
        nulls = "NULL::DOUBLE AS outdoor_temp__raw__mean, NULL::BIGINT AS outdoor_temp__raw__count"
        none = ", ".join(f"NULL::{t} AS {n}__{m}" for n in ("m1__raw", "m1__sqrt_inv", "m1__sqrt_inv__norm") for m, t in (("mean", "DOUBLE"), ("count", "BIGINT")))
        windows.append(f"""SELECT {K}, '{label}' AS "window", {sql_bucket('ts', seconds)} AS ts, {bio}, {nulls} FROM normed GROUP BY ALL""")
        windows.append(f"""SELECT {K}, '{label}' AS "window", {sql_bucket('ts', seconds)} AS ts, {none},
          {sql_r6('avg(outdoor_temp)')} AS outdoor_temp__raw__mean, count(outdoor_temp) AS outdoor_temp__raw__count FROM env_filled GROUP BY ALL""")
    norm = "(inv - lo) / (hi - lo)"
    return f"""WITH {COARSE.replace('FROM readings)', f'FROM readings WHERE {where})')}, {DEDUP}, {BOUNDED},
      cleaned AS ({sql_spikes('bounded', ('m1',), 10, 40)}),
      slots AS (SELECT {K}, ts, avg(m1) AS m1 FROM cleaned GROUP BY ALL),
      first AS (SELECT {K}, ts, arg_min(m1, seq) FILTER (m1 IS NOT NULL) AS m1 FROM cleaned GROUP BY ALL),
      trimmed AS (SELECT * FROM first QUALIFY ts >= min(ts) FILTER (m1 IS NOT NULL) OVER (PARTITION BY {K})
                    OR min(ts) FILTER (m1 IS NOT NULL) OVER (PARTITION BY {K}) IS NULL),
      grid AS ({sql_grid('trimmed', 600, ('m1',))}), filled AS ({sql_ffill('grid', 6, ('m1',))}),
      inverted AS (SELECT *, CASE WHEN m1 > 0 THEN 1 / sqrt(m1) END AS inv FROM filled),
      fit AS (SELECT device_id, {sql_r6('quantile_cont(inv, 0.02)')} AS lo, {sql_r6('quantile_cont(inv, 0.98)')} AS hi FROM inverted GROUP BY ALL),
      normed AS (SELECT i.*, CASE WHEN hi = lo THEN 0.0 WHEN {norm} < 0 THEN 0.0 WHEN {norm} > 1 THEN 1.0 ELSE {norm} END AS norm
        FROM inverted i JOIN fit USING (device_id)),
      env AS (SELECT experience, device_id, 'environment' AS "domain", "day", ts, avg(m0) AS outdoor_temp FROM coarse GROUP BY ALL),
      env_grid AS ({sql_grid('env', 600, ('outdoor_temp',))}), env_filled AS ({sql_ffill('env_grid', 6, ('outdoor_temp',))})
    """ + " UNION ALL ".join(windows)


@QUERIES.add(_sql_flow())
def flow_full(spark, sf_dir):
    """Raw lines to aggregates in two domains, one lazy chain."""
    tail = [s for s in steps() if s.step != "parse"]
    return stacked(run_flow(tail, parsed(spark, sf_dir)))


@QUERIES.add(_sql_flow())
def flow_slice(spark, sf_dir):
    """Files and stages on disk: the first steps in one run, the rest in another that starts from the last stage."""
    root = scratch_path(spark, "dataset")
    named = lines(spark, sf_dir).withColumn("name", F.regexp_replace("source_file", r"\.csv$", ""))
    ordered = named.repartition("name").sortWithinPartitions("name", "seq").select("name", "value")
    ordered.write.partitionBy("name").text(f"{root}/00_raw")
    tables = run_flow(steps(root), spark=spark, source=f"{root}/00_raw", last="clean")
    assert set(tables) == set(DOMAINS)
    return stacked(run_flow(steps(root), spark=spark, first="resample"))


WINDOW = ("2024-01-09T00:00:00Z", "2024-01-16T12:00:00Z")
IN_WINDOW = "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16 12:00:00'"


@QUERIES.add(_sql_flow(f"epoch_us(ts) // 600000000 * 600000000 >= epoch_us(TIMESTAMP '{WINDOW[0][:10]}') AND ts < TIMESTAMP '2024-01-16 12:00:00'"))
def step_window(spark, sf_dir):
    """A step's own window narrows what it and the later steps see."""
    tail = [s for s in steps() if s.step != "parse"]
    tail[0] = FlowStep("clean", tail[0].params, start=WINDOW[0], end=WINDOW[1])
    return stacked(run_flow(tail, parsed(spark, sf_dir), start="2024-01-01", end="2024-02-01"))


@QUERIES.add(_sql_flow())
def reprocess_days(spark, sf_dir):
    """Clean and aggregate written once, some days run again: nothing changes."""
    root = scratch_path(spark, "dataset")
    tail = [s for s in steps(root) if s.step != "parse"]
    tables = parsed(spark, sf_dir)
    run_flow(tail, tables, spark=spark)
    again = [FlowStep(s.step, s.params, output=s.output) for s in tail[:3]]
    reprocess(again, "2024-01-09", "2024-01-12", tables=tables, spark=spark)
    return stacked(run_flow(tail, spark=spark, first="transform"))


@custom_step("offset_scale", {"column": ((str,), "m1"), "factor": ((int, float), 2.0), "offset": ((int, float), 0)})
def offset_scale(df, column, factor, offset):
    return df.withColumn(column, F.col(column) * F.lit(float(factor)) + F.lit(float(offset)))


@QUERIES.add(
    f"""WITH {COARSE}, {DEDUP} SELECT {K}, ts, CAST(m1 * 3 - 5 AS DOUBLE) AS m1 FROM deduped"""
)
def custom_step_flow(spark, sf_dir):
    """A user's step with declared parameters between built-in ones."""
    flow = [FlowStep("clean", {"domains": {"bio_signal": {}}}), FlowStep("offset_scale", {"factor": 3})]
    out = run_flow(flow, {"bio_signal": coarse(spark, sf_dir)}, overrides={"offset": -5})
    return out["bio_signal"].select("experience", "device_id", "domain", "day", "ts", "m1")


@QUERIES.add(
    f"""WITH {COARSE}, {DEDUP} SELECT {K}, ts, m1, {sql_r6('CASE WHEN m1 > 0 THEN 1 / sqrt(m1) END')} AS m1__sqrt_inv,
      {sql_r6('CASE WHEN m1 > 0 THEN ln(m1) END')} AS m1__log FROM deduped"""
)
def flow_repeated_steps(spark, sf_dir):
    """Two steps of one kind, each with its own parameters."""

    def transform(function):
        return FlowStep("transform", {"transforms": [{"function": function, "target": {"columns": ["m1"]}}]})

    flow = [FlowStep("clean", {"domains": {"bio_signal": {}}}), transform("sqrt_inv"), transform("log")]
    out = run_flow(flow, {"bio_signal": coarse(spark, sf_dir)})["bio_signal"]
    return round_all(out.select("experience", "device_id", "domain", "day", "ts", "m1", "m1__sqrt_inv", "m1__log"))


@QUERIES.add(
    f"""WITH {COARSE} SELECT 'EVT' AS experience, device_id, "day", ts, m1, {sql_r6('m0')} AS outdoor_temp FROM coarse
    WHERE ts >= TIMESTAMP '2024-01-09 06:00:00' AND ts < TIMESTAMP '2024-01-11'"""
)
def raw_window(spark, sf_dir):
    """A windowed run over raw files of all device-days reads only files dated near the window."""
    path = f"{scratch_path(spark, 'dataset')}/00_raw"
    named = lines(spark, sf_dir).withColumn("name", F.regexp_replace("source_file", r"\.csv$", ""))
    named.repartition("name").sortWithinPartitions("name", "seq").select("name", "value").write.partitionBy(
        "name"
    ).text(path)
    both = {"reading": {"columns": ["m1", "outdoor_temp"], "dtype": "float"}}
    step = FlowStep("parse", {"domains": both, "keys": ["m1", "outdoor_temp"]})
    out = run_flow([step], spark=spark, source=path, start="2024-01-09T06:00:00Z", end="2024-01-11")["reading"]
    days = [r.d for r in out.select(F.substring("source_file", -10, 10).alias("d")).distinct().collect()]
    assert set(days) <= {"2024-01-08", "2024-01-09", "2024-01-10"}
    return round_all(
        out.select("experience", "device_id", "day", "ts", F.col("m1").cast("long").alias("m1"), "outdoor_temp")
    )
