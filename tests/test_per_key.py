import math

import pyarrow as pa
import pytest
from helpers import at, frame, noisy, rows, to_pandas

from tidegrid.operators import normalize as N
from tidegrid.operators.per_key import apply_per_key
from tidegrid.plans import counters
from tidegrid.plans import history as H


def code():
    """A function of its own, as workers cannot import the tests."""

    def shifted(table):
        return pa.table({"device_id": table["device_id"], "ts": table["ts"], "rank": pa.array(range(table.num_rows))})

    return shifted


SHAPE = "device_id string, ts timestamp, rank long"


def test_code_sees_each_key_in_order(spark):
    shifted = code()
    data = rows([(5, 1, 1.0), (1, 2, 1.0), (3, 3, None)], "a") + rows([(2, 1, 1.0)], None)
    out = to_pandas(apply_per_key(frame(spark, data), shifted, SHAPE), ("ts",))
    assert list(out["rank"]) == [0, 0, 1, 2]
    sliced = to_pandas(apply_per_key(frame(spark, data), shifted, SHAPE, slice_length="2s"), ("ts",))
    assert list(sliced["rank"]) == [0, 0, 0, 0]
    assert apply_per_key(frame(spark, []), shifted, SHAPE).count() == 0


def test_declared_schema_and_hot_keys_are_checked(spark):
    df, shifted = frame(spark, noisy(20)), code()
    with pytest.raises(ValueError, match="slice length"):
        apply_per_key(df, shifted, SHAPE, limit=10)
    assert apply_per_key(df, shifted, SHAPE, limit=10, slice_length="3s").count() == 20
    for wrong, message in (
        (lambda t: t.select(["ts"]), "not the declared"),
        (lambda t: t.num_rows, "Arrow table"),
        (lambda t: shifted(t).set_column(2, "rank", pa.array(["x"] * t.num_rows)), "do not fit"),
    ):
        with pytest.raises(Exception, match=message):
            apply_per_key(df, wrong, SHAPE).collect()


@pytest.mark.parametrize("split", [False, True])
def test_filled_values_are_counted_beside_the_write(spark, tmp_path, split):
    df = frame(spark, rows([(0, 1, None), (4, None, 2.0), (9, 3, None)]))
    path = str(tmp_path / "out")
    got = counters.quality_resample(df, lambda d: d.write.parquet(path), max_gap_fill=2, method="nearest", split=split, slots=3)
    back = spark.read.parquet(path)
    assert "_filled_values" not in back.columns
    assert got == {"rows": 10, "values": 3 + 4, "filled": 4}
    assert back.count() == 10


def test_replaced_columns_are_counted_once(spark, tmp_path):
    df = frame(spark, rows([(0, 1, 4.0), (1, None, 9.0)]))
    spec = [
        {"function": "identity", "target": {"columns": ["m1"]}, "mode": "replace"},
        {"function": "log", "target": {"columns": ["m1", "gone"]}, "mode": "replace"},
        {"function": "sqrt_inv", "target": {"domain": "other"}, "mode": "add"},
    ]
    got = counters.quality_transform(df, lambda d: d.write.parquet(str(tmp_path / "t")), spec, "bio_signal")
    assert got == {"rows": 2, "values": 2, "columns_added": 0, "columns_replaced": 1}


def test_sketched_fit_reads_sketches_of_its_days(spark):
    data = rows([(d * 86_400 + i, 1000 * d + i, None if d else float(i)) for d in range(3) for i in range(100)])
    sketches = N.sketch_days(frame(spark, data), columns=["m0", "m1"])
    assert sketches.count() == 4  # no sketch where a day has no value
    two = {r.column: (r.lo, r.hi) for r in N.fit_sketched(sketches, 0, 100, window_days=2).collect()}
    assert two == {"m0": (1000.0, 2099.0)}
    every = {r.column: r for r in N.fit_sketched(sketches, 10, 90).collect()}
    assert abs(every["m1"].lo - 10) <= 2 and abs(every["m1"].hi - 90) <= 2
    direct = {r.column: (r.lo, r.hi) for r in N.fit(frame(spark, data), "sketch", p_min=10, p_max=90, columns=["m0", "m1"]).collect()}
    assert direct == {c: (r.lo, r.hi) for c, r in every.items()}
    assert N.sketch_days(frame(spark, []), columns=["m0"]).count() == 0 and not math.isnan(every["m0"].lo)


def test_a_skipped_step_ends_a_run(spark):
    schema = "ts timestamp, run_id string, flow string, treatment string, status string, duration_ms double, error string"
    events = spark.createDataFrame(
        [
            (at(0), "r", "f", "parse", "start", None, None),
            (at(1), "r", "f", "parse", "skip", 5.0, None),
            (at(2), "q", None, "clean", "start", None, None),
            (at(4), "q", None, "clean", "error", 7.0, "first"),
            (at(5), "q", None, "fit", "error", 1.0, "second"),
        ],
        schema,
    )
    steps = spark.createDataFrame([("f", 1)], "flow string, n_steps int")
    got = {r.run_id: r for r in H.run_outcomes(events, steps).collect()}
    assert (got["r"].status, got["r"].duration_ms, got["r"].error) == ("success", 5.0, None)
    assert (got["q"].status, got["q"].failed_step, got["q"].error, got["q"].duration_ms) == ("error", "clean", "first", 8.0)


