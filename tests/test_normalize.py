import random

import numpy as np
import pytest
from helpers import assert_close, frame, rows, to_pandas
from pyspark.sql import functions as F

from tidegrid.operators import normalize as N
from tidegrid.operators import quantiles as Q
from tidegrid.sinks.params import load_params, save_params


def hundred(device, low=0, day=0):
    return rows([(day * 86_400 + i, low + i, float(100 + low + i)) for i in range(100)], device)


def bounds(params):
    return {(r.device_id, r.column): (r.lo, r.hi) for r in params.collect()}


@pytest.mark.parametrize("split", [False, True])
def test_percentiles_per_device(spark, split):
    df = frame(spark, hundred("a") + hundred("a", day=1) + hundred("b", 50))
    got = bounds(N.fit_percentile(df, split=split))
    both = np.concatenate([np.arange(100), np.arange(100)])
    assert got[("a", "m0")] == pytest.approx((np.percentile(both, 2), np.percentile(both, 98)))
    assert got[("b", "m1")] == pytest.approx((150 + 1.98, 150 + 97.02))


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_narrowed_quantiles_equal_numpy(spark, bins):
    rng = random.Random(bins)
    values = [rng.gauss(0, 1) for _ in range(300)] + [1e300, -1e300, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([("g", v) for v in values], ["g", "v"])
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = Q.exact_quantiles(df, ["g"], ["v"], probs, split=True, bins=bins).first().quantiles
    assert_close(got, np.percentile(values, [p * 100 for p in probs]))


def test_column_without_values_gives_no_bounds(spark):
    df = frame(spark, rows([(0, None, 1.0), (1, None, 2.0)]))
    for split in (False, True):
        assert set(bounds(N.fit_percentile(df, split=split))) == {("gauge.4", "m1")}
    assert set(bounds(N.fit_minmax(df))) == {("gauge.4", "m1")}


def test_last_days_count_from_the_newest_day_of_any_device(spark):
    df = frame(spark, hundred("a") + hundred("a", 500, day=2) + hundred("b", 900, day=3))
    assert set(bounds(N.fit(df, window_days=1))) == {("b", "m0"), ("b", "m1")}
    assert bounds(N.fit(df, "minmax", window_days=2))[("a", "m0")] == (500, 599)
    assert bounds(N.fit(df, "minmax"))[("a", "m0")] == (0, 599)


def test_scaling_and_clipping(spark):
    df = frame(spark, rows([(0, 0, 0.0), (1, 50, None), (2, 100, 1.0)]))
    params = spark.createDataFrame(
        [("EXP", "gauge.4", "m0", 20.0, 80.0), ("EXP", "gauge.4", "m1", 3.0, 3.0)],
        ["experience", "device_id", "column", "lo", "hi"],
    )
    out = to_pandas(N.normalize(df, params))
    assert_close(out.m0, [0.0, 0.5, 1.0])
    assert_close(out.m1, [0.0, 0.0, 0.0])
    raw = to_pandas(N.normalize(df, params, columns=["m0"], clip=False))
    assert_close(raw.m0, [-1 / 3, 0.5, 4 / 3])
    assert_close(raw.m1, [0.0, None, 1.0])


def test_nulls_stay_null_when_clipped(spark):
    df = frame(spark, rows([(0, None, None), (1, 5, 5.0)]))
    out = to_pandas(N.normalize(df, N.fit(frame(spark, hundred("gauge.4")))))
    assert_close(out.m0, [None, (5 - 1.98) / (97.02 - 1.98)])


def test_unknown_device_fails(spark):
    params = N.fit(frame(spark, hundred("a")))
    other = frame(spark, hundred("b"))
    assert [r.device_id for r in N.missing_groups(other, params).collect()] == ["b"]
    with pytest.raises(Exception, match="no fitted bounds for EXP/b"):
        N.normalize(other, params).collect()


def test_small_ranges_are_reported(spark):
    params = N.fit(frame(spark, hundred("a")), "minmax")
    assert N.check_ranges(params, 0).count() == 0
    assert N.check_ranges(params, 100).count() == 2


def test_params_live_outside_the_stage(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_params(spark, str(tmp_path / "none"))
    df = frame(spark, hundred("a"))
    save_params(N.fit(df), str(tmp_path / "fit"), N.fit_meta(df, N.fit(df)))
    assert bounds(load_params(spark, str(tmp_path / "fit"))) == bounds(N.fit(df))
    meta = spark.read.parquet(str(tmp_path / "fit" / "meta")).first()
    assert (meta.n_inputs, meta.n_groups, meta.fit_window_days) == (1, 1, "all")


def test_join_is_not_broadcast_beyond_the_bound(spark):
    from tidegrid.keys import broadcast_if_small

    df = spark.range(100).withColumn("x", F.lit(1))
    assert "ResolvedHint" in broadcast_if_small(df, 200)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, 199)._jdf.queryExecution().analyzed().toString()
