import pandas as pd
import pytest
from helpers import assert_close, frame, noisy, rows, to_pandas

from tidegrid.operators import aggregate as A
from tidegrid.operators import grid as G


def pandas_resample(data, freq, limit, method):
    p = pd.DataFrame([(r[4], r[6], r[7]) for r in data], columns=["ts", "m0", "m1"])
    p["ts"] = pd.to_datetime(p.ts, utc=True).dt.floor("s")
    p = p.astype({"m0": "Float64", "m1": "Float64"})
    p = p.groupby("ts", as_index=False).agg({"m0": method, "m1": method})
    p = p.loc[p[["m0", "m1"]].dropna(how="all").index[0]:]
    index = pd.date_range(p.ts.min().floor(freq), p.ts.max(), freq=freq)
    p = p.set_index("ts").reindex(index)
    if limit:
        p = p.ffill(limit=limit)
    p["m0"] = p["m0"].round()
    return p


@pytest.mark.parametrize("freq", ["500ms", "1s", "3s"])
@pytest.mark.parametrize("method", ["first", "mean"])
def test_resample_equals_pandas(spark, freq, method):
    data = noisy(200, seed=4, step=0.7, nulls=0.4)
    got = to_pandas(G.resample(frame(spark, data), freq=freq, max_gap_fill=2, method=method))
    want = pandas_resample(data, freq, 2, method)
    assert list(pd.to_datetime(got.ts, utc=True)) == list(want.index)
    assert_close(got.m0, want.m0)
    assert_close(got.m1, want.m1)


def test_fill_takes_the_first_rows_of_a_long_gap(spark):
    data = rows([(0, 1, 1.0), (1, None, 1.0), (2, 2, None), (6, 3, None)])
    got = to_pandas(G.resample(frame(spark, data), max_gap_fill=2, method="nearest"))
    assert_close(got.m0, [1, 1, 2, 2, 2, None, 3])
    assert_close(got.m1, [1.0, 1.0, 1.0, 1.0, None, None, None])
    assert_close(to_pandas(G.resample(frame(spark, data), max_gap_fill=0)).m0, [1, None, 2, None, None, None, 3])


@pytest.mark.parametrize(("freq", "unit", "limit", "slots"), [("1s", "1s", 2, 3), ("2s", "1s", 4, 5), ("10s", "1s", 0, 1), ("500ms", "100ms", 3, 7)])
def test_slices_equal_whole_keys(spark, freq, unit, limit, slots):
    """Gaps over many slices, values carried from slice to slice, keys without values, two devices."""
    gap = [(r[0] + 500, r[1], r[2]) for r in [(0.3, 5, None), (1, None, 2.0), (7, 6, 6.0)]]
    data = noisy(60, seed=4, step=0.7) + rows([(0.2, None, None), (3, None, None), (4.5, None, 1.0), *gap], "b")
    data += rows([(1, None, None), (5, None, None)], "empty")
    options = {"freq": freq, "unit": unit, "max_gap_fill": limit, "method": "nearest"}
    whole = to_pandas(G.resample(frame(spark, data), split=False, **options))
    sliced = to_pandas(G.resample(frame(spark, data), split=True, slots=slots, **options))
    pd.testing.assert_frame_equal(whole, sliced)
    assert (sliced.device_id == "empty").sum() == 2 and len(sliced) > 60


def test_no_array_is_as_long_as_a_gap(spark):
    df = frame(spark, rows([(0, 1, 1.0), (4000, 2, None)]))
    out = G.resample(df, freq="100ms", unit="100ms", max_gap_fill=5, slots=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    got = to_pandas(out)
    assert len(got) == 40_001
    assert_close(got.m0[:8], [1, 1, 1, 1, 1, 1, None, None])
    assert got.m0.count() == 7 and got.m0.iloc[-1] == 2


def test_leading_null_rows_go_trailing_stay(spark):
    data = rows([(0, None, None), (1, None, 5.0), (2, None, None)])
    for split in (False, True):
        got = to_pandas(G.trim_leading_nulls(frame(spark, data), split=split))
        assert_close(got.m1, [5.0, None])


def test_key_without_any_value_keeps_its_rows_without_a_grid(spark):
    data = rows([(0, None, None), (0.4, None, None), (9, None, None)], "empty") + rows([(0, 1, 1.0), (3, 1, 1.0)], "full")
    got = to_pandas(G.resample(frame(spark, data)))
    assert list(got.device_id) == ["empty"] * 2 + ["full"] * 4


def test_off_grid_rows_only_set_the_ends(spark):
    data = rows([(7, 1, None), (10, 2, None), (13, 3, None), (41, 4, None)])
    got = to_pandas(G.regular_grid(frame(spark, data), "10s"))
    assert [t.second for t in got.ts] == [0, 10, 20, 30, 40]
    assert_close(got.m0, [None, 2, None, None, None])


def test_days_do_not_touch(spark):
    data = rows([(86_390, 1, 1.0), (86_399, 2, 2.0), (86_405, 3, 3.0)])
    got = to_pandas(G.resample(frame(spark, data), max_gap_fill=20))
    assert len(got) == 11


METRICS = ["mean", "std", "min", "max", "median", "sum", "count", "first", "last", "var", "nunique"]


@pytest.mark.parametrize("window", ["10s", "7min", "1h"])
def test_tumble_equals_pandas(spark, window):
    data = noisy(250, seed=6, step=20.0)
    got = to_pandas(A.tumble(frame(spark, data), window, METRICS))
    p = pd.DataFrame([(r[4], r[6], r[7]) for r in data], columns=["ts", "m0", "m1"])
    p["ts"] = pd.to_datetime(p.ts, utc=True)
    want = p.astype({"m0": "Float64", "m1": "Float64"}).set_index("ts").resample(window).agg(METRICS)
    assert list(pd.to_datetime(got.ts, utc=True)) == list(want.index)
    for c in ("m0", "m1"):
        for m in METRICS:
            assert_close(got[f"{c}__raw__{m}"], want[(c, m)], 1e-7)


def test_medians_of_big_groups(spark):
    df = frame(spark, noisy(250, seed=6, step=20.0))
    small = to_pandas(A.tumble(df, "1h", ["median", "mean"], split=False))
    big = to_pandas(A.tumble(df, "1h", ["median", "mean"], split=True))
    pd.testing.assert_frame_equal(small, big)


def test_single_row_bucket_and_rounding(spark):
    data = rows([(0, 1, 0.125), (0.5, 2, 0.125), (20, 5, 0.375)])
    got = to_pandas(A.multi_window(frame(spark, data), ["1s", "10s"], ["mean", "std"], decimals=2), ("window", "ts"))
    ten = got[got.window == "10s"]
    assert_close(ten["m1__raw__mean"], [0.12, None, 0.38])
    assert_close(ten["m0__raw__std"], [0.71, None, None])
    assert len(got[got.window == "1s"]) == 21


def test_derived_columns_keep_their_middle_part(spark):
    df = frame(spark, rows([(0, 1, 1.0)])).withColumnRenamed("m0", "m0__log")
    assert "m0__log__mean" in A.tumble(df, "1h", ["mean"]).columns
    with pytest.raises(ValueError, match="unknown metric"):
        A.tumble(df, "1h", ["mode"])
