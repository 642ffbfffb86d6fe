"""Small sensor tables and their pandas counterparts."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import types as T

UTC = dt.timezone.utc
START = dt.datetime(2026, 1, 20, tzinfo=UTC)

SCHEMA = T.StructType(
    [
        T.StructField("experience", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("m0", T.LongType()),
        T.StructField("m1", T.DoubleType()),
    ]
)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def rows(values, device="gauge.4", domain="bio_signal", experience="EXP"):
    """``values``: (seconds, m0, m1) triples, one row each, in source order."""
    return [
        (experience, device, domain, at(s).date(), at(s), i, m0, m1)
        for i, (s, m0, m1) in enumerate(values)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def noisy(n=300, seed=1, step=1.0, nulls=0.15, device="gauge.4"):
    rng = random.Random(seed)
    out, t = [], 0.0
    for _ in range(n):
        t += step * rng.choice((1, 1, 1, 1, 2, 5))
        m0 = None if rng.random() < nulls else rng.choice((300, 310, 320, 700))
        m1 = None if rng.random() < nulls else round(rng.uniform(0, 100), 3)
        out.append((t, m0, m1))
    return rows(out, device)


def to_pandas(df, order=("device_id", "ts")):
    return (
        pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
        .sort_values(list(order))
        .reset_index(drop=True)
    )


def plain(values):
    return [None if v is None or v is pd.NA or v != v else v for v in values]


def assert_close(ours, theirs, tolerance=1e-9):
    ours, theirs = plain(ours), plain(theirs)
    assert len(ours) == len(theirs)
    for i, (a, b) in enumerate(zip(ours, theirs)):
        assert (a is None) == (b is None), (i, a, b)
        if a is not None:
            assert abs(a - b) <= tolerance * max(1, abs(b)), (i, a, b)
