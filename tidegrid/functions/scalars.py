"""Scalar functions on columns, with the null and rounding rules of the data model."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.keys import DAY_MICROS

# Unit suffixes of window and grid labels, in microseconds.
UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}

# What counts as a number in a raw field.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DIGITS_PATTERN = r"^\s*[+-]?\d+\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def micros_of(label: str) -> int:
    """Length of a window label such as ``10s``, ``5min``, ``1h`` or ``500ms``."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", label)
    unit = m and m.group(2).lower()
    if not m or unit not in UNIT_MICROS:
        raise ValueError(f"not a time length: {label!r}")
    size = int(m.group(1) or 1) * UNIT_MICROS[unit]
    if size <= 0:
        raise ValueError(f"not a positive time length: {label!r}")
    return size


def once(col: Column) -> Column:
    """The same value, worked out once a row; to be used as a column of its own.

    Filters on a plain projection move below it and work its expressions out again, each
    filter for itself. They do not move below rows that are generated.
    """
    return F.explode(F.array(col))


# --- numbers -----------------------------------------------------------------


def coerce_float(col: Column) -> Column:
    """Text to double; anything that is not a plain number is null."""
    return F.when(
        col.rlike(NUMBER_PATTERN) | col.rlike(INFINITY_PATTERN), col.try_cast("double")
    )


def coerce_int(col: Column) -> Column:
    """Text to long; fractional, infinite or malformed values are null."""
    value = F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))
    # Digits alone are read as they stand: a double holds only 53 bits of them.
    digits = F.when(col.rlike(DIGITS_PATTERN), F.trim(col).try_cast("long"))
    return F.coalesce(digits, F.when(value == F.rint(value), value.try_cast("long")))


def drop_nan(col: Column) -> Column:
    """NaN to null: Spark orders NaN above every number, the data model has no NaN."""
    return F.when(~F.isnan(col), col)


def without_nan(df: DataFrame) -> DataFrame:
    """A table as the data model has it: no NaN in any floating column."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: drop_nan(F.col(f"`{c}`")) for c in floating}) if floating else df


def round_even(col: Column, decimals: int = 0) -> Column:
    """Round half to even, as numpy does (``round`` in Spark rounds half up)."""
    scale = F.lit(float(10**decimals))
    return F.rint(col.cast("double") * scale) / scale


def to_long_even(col: Column) -> Column:
    """Round half to even into a nullable long."""
    return F.rint(col.cast("double")).cast("long")


# --- transforms --------------------------------------------------------------


def _positive(col: Column, result: Column) -> Column:
    return F.when(col > 0, result)


def sqrt_inv(col: Column) -> Column:
    x = col.cast("double")
    return _positive(x, F.lit(1.0) / F.sqrt(x))


def cbrt_inv(col: Column) -> Column:
    x = col.cast("double")
    return _positive(x, F.lit(1.0) / F.cbrt(x))


def log(col: Column) -> Column:
    x = col.cast("double")
    return _positive(x, F.log(x))


def identity(col: Column) -> Column:
    return col.cast("double")


TRANSFORMS = {"sqrt_inv": sqrt_inv, "cbrt_inv": cbrt_inv, "log": log, "identity": identity}


# --- time --------------------------------------------------------------------


def parse_ts(col: Column, tz: str = "UTC") -> Column:
    """ISO text to timestamp. Text without an offset is local time in ``tz``."""
    if tz == "UTC":
        return col.cast("timestamp")
    has_offset = col.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
    return F.when(has_offset, col.cast("timestamp")).otherwise(
        F.to_utc_timestamp(col.cast("timestamp"), tz)
    )


def parse_iso_utc(text: str | datetime) -> datetime:
    """ISO 8601 text to an aware UTC datetime; no offset means UTC."""
    if isinstance(text, datetime):
        moment = text
    else:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def moment(text: str | datetime) -> Column:
    """A literal timestamp, independent of the session time zone."""
    utc = parse_iso_utc(text)
    micros = int(utc.timestamp()) * 1_000_000 + utc.microsecond
    return F.timestamp_micros(F.lit(micros))


def floor_ts(ts: Column, unit: str = "1s") -> Column:
    """Floor to multiples of ``unit`` counted from the epoch."""
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(micros_of(unit))))


def bucket_start(ts: Column, step: int | Column) -> Column:
    """Start of the tumbling bucket holding ``ts``, counted from midnight of its day.

    Counting from midnight matters for lengths that do not divide a day.
    """
    us = F.unix_micros(ts)
    size = step if isinstance(step, Column) else F.lit(step)
    return F.timestamp_micros(us - F.pmod(F.pmod(us, F.lit(DAY_MICROS)), size))


def local_time(ts: Column, tz: str) -> Column:
    """UTC instant to wall-clock text in an IANA zone."""
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def extract_date(name: Column) -> Column:
    """First ``YYYY-MM-DD`` in a string, or null."""
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
