"""Flows: an ordered list of steps composed into one lazy plan.

A flow carries one DataFrame per domain from step to step. Nothing is computed
until the result is written or read, so Catalyst sees the chain from parse to
aggregate as one plan. A step may name an ``output`` path; its table is then
written there and read back, and later runs can start from it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidegrid.functions.names import domain_columns
from tidegrid.functions.scalars import parse_iso_utc, without_nan
from tidegrid.keys import ROWS_PER_TASK, SEQ, data_columns, needs_slices
from tidegrid.operators import aggregate, clean, columns, grid, normalize
from tidegrid.operators.per_key import apply_per_key
from tidegrid.plans import history
from tidegrid.session import cut_lineage
from tidegrid.sinks.params import load_params, save_params
from tidegrid.sinks.stage import write_stage
from tidegrid.sinks.versions import write_version
from tidegrid.sources.raw import available_keys, domain_columns_of, parsed_lines, read_lines, type_domains, type_rows
from tidegrid.sources.stage import read_stage
from tidegrid.sources.versions import largest_key, stored_domains

REQUIRED = object()
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """A named function over the tables, its declared parameters and their types."""

    name: str
    run: Callable[[Tables, dict], Tables]
    params: Mapping[str, tuple[tuple[type, ...], Any]] = field(default_factory=dict)


REGISTRY: dict[str, Step] = {}


def register(step: Step) -> Step:
    """Add a step. A later registration of the same name wins, so users can override."""
    REGISTRY[step.name] = step
    return step


def custom_step(name: str, params: Mapping[str, tuple] | None = None):
    """Decorator: ``fn(df, **params)`` becomes a step applied to every domain table."""

    def wrap(fn: Callable[..., DataFrame]):
        def run(tables: Tables, p: dict) -> Tables:
            declared = {n: v for n, v in p.items() if not n.startswith("_")}
            return {d: fn(t, **declared) for d, t in tables.items()}

        register(Step(name, run, dict(params or {})))
        return fn

    return wrap


def custom_key_step(
    name: str,
    schema: Callable[[DataFrame], str] | str,
    params: Mapping[str, tuple] | None = None,
    **options,
):
    """Decorator: ``fn(table, **params)`` becomes a step applied to the rows of every key.

    ``schema`` declares the columns it returns, as DDL or as a function of the step's input;
    ``options`` are those of ``apply_per_key``.
    """

    def wrap(fn: Callable[..., Any]):
        def run(tables: Tables, p: dict) -> Tables:
            declared = {n: v for n, v in p.items() if not n.startswith("_")}

            def of(df: DataFrame) -> DataFrame:
                shape = schema if isinstance(schema, str) else schema(df)
                return apply_per_key(df, lambda table: fn(table, **declared), shape, **options)

            return {d: of(t) for d, t in tables.items()}

        register(Step(name, run, dict(params or {})))
        return fn

    return wrap


def resolve_params(step: Step, *layers: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults overlaid by the layers in order, shallowly; unknown names and wrong types raise."""
    values = {n: d for n, (_, d) in step.params.items() if d is not REQUIRED}
    for layer in layers:
        unknown = set(layer) - set(step.params)
        if unknown:
            raise ValueError(f"step {step.name!r} has no parameter {sorted(unknown)}")
        values.update(layer)
    for name, (types, _) in step.params.items():
        if name not in values:
            raise ValueError(f"step {step.name!r} needs parameter {name!r}")
        value = values[name]
        if value is not None and not isinstance(value, types):
            raise TypeError(f"parameter {name!r} of {step.name!r} cannot be {type(value).__name__}")
    return values


# --- built-in steps ----------------------------------------------------------

# Parameter defaults of the built-in steps.
DOMAIN_SPEC = {
    "bio_signal": {"prefix": "m", "dtype": "int"},
    "environment": {"columns": ["outdoor_temp"], "dtype": "float"},
}
CLEAN_RULES = {
    "bio_signal": {"min_value": 0, "max_value": 800, "spike_window": 10, "spike_threshold": 100},
    "environment": {"min_value": -10.0, "max_value": 50.0, "spike_window": 7, "spike_threshold": 5.0},
}
AGG_METHOD = {"bio_signal": "nearest", "environment": "mean"}
TRANSFORM_SPEC = [{"function": "cbrt_inv", "target": {"domain": "bio_signal"}, "mode": "add"}]

NUMBER = (int, float)


def _lines(p: dict) -> DataFrame:
    return parsed_lines(
        p["_spark"],
        p["_input"],
        delimiter=p["delimiter"],
        tz=p["tz"],
        substitutions=p["file_name_substitute"],
        start=p["_start"],
        end=p["_end"],
    )


def _parse(tables: Tables, p: dict) -> Tables:
    return type_domains(_lines(p), p["domains"], p["keys"])


def _parse_and_write(p: dict, path: str, mode: str, start, end) -> Tables:
    """Parse into a stage table: one pass over the text for all domains."""
    lines = _lines(p)
    keys = available_keys(lines, p["domains"], p["keys"])
    columns_of = domain_columns_of(lines, p["domains"], keys)
    rows = type_rows(lines, p["domains"], keys)
    write = write_version if p["_versioned"] else write_stage
    write(columns.range_filter(rows, start, end), path, mode, start, end)
    stage = read_stage(p["_spark"], path)
    common = [c for c in ("source_file", "seq", "experience", "device_id", "domain", "day", "ts") if c in rows.columns]
    return {
        d: columns.range_filter(columns.keep_domains(stage, [d]), start, end).select(*common, *names)
        for d, names in columns_of.items()
    }


def _clean(tables: Tables, p: dict) -> Tables:
    out = clean.pass_or_clean(tables, p["domains"], p["drop_duplicates"], split=p["split"])
    if p["drop_duplicates"]:
        # Times are distinct now, so the row order has no further use.
        out = {d: t.drop(SEQ) if d in p["domains"] else t for d, t in out.items()}
    return out


def _resample(tables: Tables, p: dict) -> Tables:
    return {
        d: grid.resample(
            t, freq=p["freq"], max_gap_fill=p["max_gap_fill_s"], method=p["agg_method"].get(d, "mean"),
            unit=p["unit"],
        )
        for d, t in tables.items()
    }


def _transform(tables: Tables, p: dict) -> Tables:
    return {d: columns.apply_transforms(t, p["transforms"], d) for d, t in tables.items()}


def _normalize(tables: Tables, p: dict) -> Tables:
    domain, group = p["domain"], tuple(p["group_by"])
    if domain not in tables:
        raise ValueError(f"no table for domain {domain!r}")
    target = tables[domain]
    if p["fit"]:
        # Read twice, by the fit and by the scaling: compute it once.
        target = target if p["_stored"] else cut_lineage(target, "fit-input")
        fitted = normalize.fit(
            target, p["method"], p_min=p["percentile_min"], p_max=p["percentile_max"],
            window_days=p["fit_window_days"], columns=p["columns"], group=group, split=p["split"],
        )
        if p["params_path"]:
            save_params(fitted, p["params_path"])
            fitted = load_params(target.sparkSession, p["params_path"])
        else:
            fitted = cut_lineage(fitted, "bounds")
    else:
        fitted = load_params(target.sparkSession, p["params_path"] or "")
    out = {
        d: t for d, t in tables.items() if d == domain or d not in p["drop_domains"]
    }
    out[domain] = normalize.normalize(target, fitted, columns=p["columns"], clip=p["clip"], group=group)
    return out


def _aggregate(tables: Tables, p: dict) -> Tables:
    return {
        d: aggregate.multi_window(t, p["windows"], p["metrics"], decimals=p["decimals"], split=p["split"])
        for d, t in tables.items()
    }


SPLIT = ((bool,), None)
register(
    Step(
        "parse",
        _parse,
        {
            "domains": ((dict,), DOMAIN_SPEC),
            "delimiter": ((str,), ";"),
            "tz": ((str,), "UTC"),
            "file_name_substitute": ((list,), []),
            "keys": ((list,), None),
        },
    )
)
register(
    Step(
        "clean",
        _clean,
        {"drop_duplicates": ((bool,), True), "domains": ((dict,), CLEAN_RULES), "split": SPLIT},
    )
)
register(
    Step(
        "resample",
        _resample,
        {
            "freq": ((str,), "1s"),
            "max_gap_fill_s": ((int,), 20),
            "agg_method": ((dict,), AGG_METHOD),
            "unit": ((str,), "1s"),
        },
    )
)
register(Step("transform", _transform, {"transforms": ((list,), TRANSFORM_SPEC)}))
register(
    Step(
        "normalize",
        _normalize,
        {
            "fit": ((bool,), False),
            "method": ((str,), "percentile"),
            "percentile_min": (NUMBER, 2.0),
            "percentile_max": (NUMBER, 98.0),
            "domain": ((str,), "bio_signal"),
            "drop_domains": ((list,), []),
            "columns": ((list, dict), []),
            "clip": ((bool,), True),
            "fit_window_days": ((int,), 0),
            "group_by": ((list, tuple), list(normalize.GROUP)),
            "params_path": ((str,), None),
            "split": SPLIT,
        },
    )
)
register(
    Step(
        "aggregate",
        _aggregate,
        {
            "windows": ((list,), list(aggregate.DEFAULT_WINDOWS)),
            "metrics": ((list,), list(aggregate.DEFAULT_METRICS)),
            "decimals": ((int,), -1),
            "split": SPLIT,
        },
    )
)


# --- running -----------------------------------------------------------------


@dataclass(frozen=True)
class FlowStep:
    """One entry of a flow."""

    step: str
    params: Mapping[str, Any] = field(default_factory=dict)
    name: str | None = None
    start: Any = None
    end: Any = None
    output: str | None = None


def label_of(entry: FlowStep) -> str:
    """What a step is called in a flow: its own name, or what it does."""
    return entry.step if entry.name is None else entry.name


def step_range(
    steps: Sequence[FlowStep], only: str | None = None, first: str | None = None, last: str | None = None
) -> range:
    """Positions of one step, or of an inclusive range. A label that two steps share is no address."""
    labels = [label_of(s) for s in steps]
    places: dict[str, int] = {}
    for wanted in {only, first, last} - {None}:
        if labels.count(wanted) != 1:
            problem = "not in flow" if wanted not in labels else "the name of several steps in"
            raise ValueError(f"step {wanted!r} {problem}: {labels}")
        places[wanted] = labels.index(wanted)
    lowest, highest = (only, only) if only is not None else (first, last)
    return range(places.get(lowest, 0), places.get(highest, len(steps) - 1) + 1)


def shared_params(steps: Sequence[FlowStep], params: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Give each step the shared parameters it declares; a name no step declares raises."""
    known = {n for s in steps for n in _step(s.step).params}
    unknown = set(params) - known
    if unknown:
        raise ValueError(f"no step of the flow has a parameter {sorted(unknown)}")
    return [{n: v for n, v in params.items() if n in _step(s.step).params} for s in steps]


def _step(name: str) -> Step:
    if name not in REGISTRY:
        raise ValueError(f"unknown step {name!r}, known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def _in_window(tables: Tables, start, end) -> Tables:
    if start is None and end is None:
        return tables
    return {d: columns.range_filter(t, start, end) for d, t in tables.items()}


def _computed_once(tables: Tables) -> Tables:
    """Tables that are counted first and worked on later, stored so that their lines are parsed once."""
    return {d: t if t.isStreaming else cut_lineage(t, "flow-input") for d, t in tables.items()}


def run_flow(
    steps: Sequence[FlowStep],
    tables: Tables | None = None,
    *,
    spark: SparkSession | None = None,
    source: str | None = None,
    params: Mapping[str, Any] | None = None,
    overrides: Mapping[str, Any] | None = None,
    start=None,
    end=None,
    only: str | None = None,
    first: str | None = None,
    last: str | None = None,
    output_mode: str = "replace",
    events_path: str | None = None,
    flow: str | None = None,
    run_id: str | None = None,
    versioned: bool = False,
) -> Tables:
    """Compose the steps and return the final table per domain.

    The chain starts from ``tables``, from the raw files in ``source``, or from
    the stage a skipped earlier step has written. A step's own ``start`` and
    ``end`` replace the flow's. Parameters: step defaults, then ``params``, then
    the step's, then ``overrides``. ``versioned`` writes each stage as a new version of its
    table; whether keys fit one task is then read from the stage's manifest.
    """
    chosen = step_range(steps, only, first, last)
    shared = shared_params(steps, params or {})
    forced = shared_params(steps, overrides or {})
    if start is not None and end is not None and parse_iso_utc(start) > parse_iso_utc(end):
        raise ValueError("start must not be after end")
    run_id = run_id or history.new_run_id()
    from_stage = False
    if tables is None and chosen and steps[chosen[0]].step != "parse":
        tables = _stage_before(steps, chosen[0], spark, shared, forced)
        from_stage = True
    tables = None if tables is None else {d: without_nan(t) for d, t in tables.items()}
    first_step, stored = True, from_stage
    split: bool | None = None
    planned: list[Callable[..., None]] = []
    for at in chosen:
        entry = steps[at]
        step = _step(entry.step)
        values = resolve_params(step, shared[at], entry.params, forced[at])
        own_start = entry.start if entry.start is not None else start
        own_end = entry.end if entry.end is not None else end
        values.update(_stored=stored, _versioned=versioned)
        if entry.step == "parse":
            values.update(_spark=spark, _input=source, _start=own_start, _end=own_end)
        elif first_step or entry.start is not None or entry.end is not None:
            tables = _in_window(tables, own_start, own_end)
        began = time.perf_counter()

        def note(
            status: str, name=entry.step, out=entry.output or "", since=_text(own_start), until=_text(own_end), **more
        ) -> None:
            if events_path and spark is not None:
                history.log_event(
                    spark, events_path, name, status, output_dir=out,
                    run_id=run_id, flow=flow, time_from=since, time_to=until, **more,
                )

        def started() -> None:
            note("start", params={k: v for k, v in values.items() if not k.startswith("_")})

        def failed(problem: Exception) -> None:
            note("error", error=str(problem), duration_ms=(time.perf_counter() - began) * 1000)

        try:
            if values.get("split", False) is None:
                # Asked once for the whole chain: later steps never have more rows of a key.
                if split is None:
                    stored_rows = largest_key(spark, steps[at - 1].output) if from_stage and at == chosen[0] else None
                    if stored_rows is None and not stored:
                        tables = _computed_once(tables or {})
                    split = (
                        any(needs_slices(t) for t in (tables or {}).values())
                        if stored_rows is None
                        else stored_rows > ROWS_PER_TASK
                    )
                values["split"] = split
        except Exception as problem:
            started()
            failed(problem)
            raise
        started()
        try:
            if step.run is _parse and _nothing_to_read(values):
                # No raw file of the window: nothing is written, nothing is replaced.
                note("skip", duration_ms=(time.perf_counter() - began) * 1000)
                return {}
            if entry.output and step.run is _parse:
                tables = _parse_and_write(values, entry.output, output_mode, own_start, own_end)
            else:
                tables = step.run(tables, values)
                if entry.step == "parse":
                    tables = _in_window(tables, own_start, own_end)
                if entry.output:
                    # A later run's results replace earlier ones of the same time.
                    write = write_version if versioned else write_stage
                    write(columns.stack_domains(tables), entry.output, output_mode, own_start, own_end, prefer="new")
                    tables = {
                        d: columns.range_filter(_domain_stage(t, entry.output, d), own_start, own_end)
                        for d, t in tables.items()
                    }
        except Exception as problem:
            failed(problem)
            raise
        if entry.output:
            # Writing has computed this step and those that waited for it.
            for done in planned:
                done("success")
            planned = []
            note("success", duration_ms=(time.perf_counter() - began) * 1000)
        else:
            note("planned")
            planned.append(note)
        first_step, stored = False, bool(entry.output)
    return tables or {}


def _text(moment) -> str | None:
    return None if moment is None else parse_iso_utc(moment).isoformat()


def _domain_stage(like: DataFrame, path: str, domain: str) -> DataFrame:
    stage = read_stage(like.sparkSession, path, domain=domain)
    return stage.select(*[c for c in like.columns if c in stage.columns])


def _nothing_to_read(values: dict) -> bool:
    """Whether a window leaves no raw file to read; names are looked at, not contents."""
    if values["_start"] is None and values["_end"] is None:
        return False
    lines = read_lines(values["_spark"], values["_input"], values["_start"], values["_end"], values["tz"])
    return lines.select("source_file").isEmpty()


def _stage_before(
    steps: Sequence[FlowStep],
    position: int,
    spark: SparkSession | None,
    shared: Sequence[Mapping[str, Any]],
    forced: Sequence[Mapping[str, Any]],
) -> Tables:
    """Tables of the step before ``position``, read from where it was written."""
    before = list(steps)[:position]
    if spark is None or not before or not before[-1].output:
        raise ValueError(
            f"nothing to start {label_of(steps[position])!r} from: pass tables or give the step before it an output"
        )
    specs: Mapping[str, Mapping] = DOMAIN_SPEC
    for i, entry in enumerate(before):
        if entry.step == "parse":
            specs = resolve_params(_step("parse"), shared[i], entry.params, forced[i])["domains"]
    stage = read_stage(spark, before[-1].output)
    found = stored_domains(spark, before[-1].output)
    if found is None:
        # One row per domain.
        found = [r["domain"] for r in stage.select("domain").distinct().collect()]
    return {d: _own_columns(columns.keep_domains(stage, [d]), d, specs) for d in sorted(found)}


def _own_columns(df: DataFrame, domain: str, specs: Mapping[str, Mapping]) -> DataFrame:
    """Leave out what other domains declare; the sensor is the name up to the first ``__``.

    Columns that no domain declares, or this one does, stay, filled or not.
    """
    sensors = {c: c.split("__")[0] for c in data_columns(df)}
    owners: dict[str, set[str]] = {}
    for name, spec in specs.items():
        given = {c: c for c in sensors.values()} | {new: old for old, new in spec.get("rename", {}).items()}
        for sensor in set(sensors.values()):
            if domain_columns([given[sensor]], spec):
                owners.setdefault(sensor, set()).add(name)
    return df.drop(*[c for c, s in sensors.items() if domain not in owners.get(s, {domain})])


def reprocess(
    steps: Sequence[FlowStep], start, end, **options
) -> Tables:
    """Re-run a window for all its days in one job; running it twice changes nothing."""
    return run_flow(steps, start=start, end=end, **options)

