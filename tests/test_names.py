import pytest

from tidegrid.functions import names as N


def test_prefix_columns_sort_by_number():
    assert N.domain_columns(["m10", "m2", "m0", "mx", "outdoor_temp"], {"prefix": "m"}) == ["m0", "m2", "m10"]


def test_listed_columns_win_and_keep_order():
    spec = {"columns": ["b", "zz", "a"], "prefix": "m"}
    assert N.domain_columns(["a", "b", "m0"], spec) == ["b", "a"]
    assert N.domain_columns(["a"], {}) == []


def test_metric_names():
    assert N.metric_name("m0", "mean") == "m0__raw__mean"
    assert N.metric_name("m0__log", "std") == "m0__log__std"


@pytest.mark.parametrize(
    "parts, expected",
    [
        ({"experience": "My-Exp", "step": "aggregated", "aggregation": "10s"}, "MY_EXP__AGGREGATED__10S"),
        ({"experience": "E", "step": "clean", "aggregation": None}, "E__CLEAN"),
        ({"experience": None, "step": "clean", "aggregation": "1h"}, "CLEAN__1H"),
        ({"experience": "E", "step": None, "aggregation": "1h"}, "E__1H"),
    ],
)
def test_table_names(parts, expected):
    assert N.table_name("{experience}__{step}__{aggregation}", parts) == expected


def test_structured_selection():
    cols = ["m0__raw__mean", "m0__raw__std", "m1__log__mean", "outdoor_temp__raw__mean", "m0__log__norm__mean"]
    assert N.select_columns(cols, ["m*"], None, ["mean"]) == ["m0__raw__mean", "m1__log__mean"]
    assert N.select_columns(cols) == cols
    assert N.select_columns(cols, ["m*"], columns=["m0__raw__std"]) == ["m0__raw__std"]


def test_column_pairs():
    cols = ["m0", "m0__sqrt_inv", "m1__sqrt_inv"]
    assert N.column_pairs(cols, []) == [(c, c) for c in cols]
    assert N.column_pairs(cols, ["m1__sqrt_inv", "zz"]) == [("m1__sqrt_inv", "m1__sqrt_inv")]
    spec = {"*__sqrt_inv": "*__norm", "m0": "m0__norm"}
    assert N.column_pairs(cols, spec) == [("m0__sqrt_inv", "m0__norm"), ("m1__sqrt_inv", "m1__norm")]
