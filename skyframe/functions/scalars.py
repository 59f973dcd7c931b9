"""Scalar Column expressions: coercion, units, timestamps, calendar parts, month ranges.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..config import KELVIN_OFFSET, KMPH_TO_MPS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x: Column | str) -> Column:
    """Lenient numeric coercion: unparseable → NULL, NaN → NULL."""
    d = _c(x).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def nan_to_null(x: Column | str) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def celsius_to_kelvin(x: Column | str) -> Column:
    return _c(x) + F.lit(KELVIN_OFFSET)


def kmph_to_mps(x: Column | str) -> Column:
    """km/h → m/s rounded to 2 decimals; bad input → NULL."""
    return F.round(to_double(x) * F.lit(KMPH_TO_MPS), 2)


def parse_timestamp(x: Column | str, fmt: str | None = None) -> Column:
    """Lenient naive-timestamp parse: bad input → NULL (callers drop those rows).

    Without a format, ISO-8601 text (space or ``T`` separator) is accepted.
    """
    if fmt is None:
        return _c(x).try_cast("timestamp_ntz")
    return F.try_to_timestamp(_c(x), F.lit(fmt)).cast("timestamp_ntz")


def parse_timestamp_strict(x: Column | str, fmt: str | None = None) -> Column:
    """Strict parse: under ANSI mode a malformed value fails the query."""
    if fmt is None:
        return _c(x).cast("timestamp_ntz")
    return F.to_timestamp_ntz(_c(x), F.lit(fmt))


def truncate_hour(x: Column | str) -> Column:
    """Truncate a naive timestamp to the hour, keeping it naive."""
    return F.date_trunc("hour", _c(x)).cast("timestamp_ntz")


def hour_from_hhmm(x: Column | str) -> Column:
    """``"1300"`` → 13, ``"0"`` → 0; unparseable → NULL."""
    return F.floor(_c(x).try_cast("int") / 100).cast("int")


def hour_text(x: Column | str) -> Column:
    """``"1300"`` → ``"13"``, ``"900"`` → ``"09"`` (two digits, zero padded)."""
    return F.lpad(hour_from_hhmm(x).cast("string"), 2, "0")


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """Calendar parts (Monday = 0) and their cyclic encodings, by output name."""
    t = _c(ts)
    hour = F.hour(t)
    doy = F.dayofyear(t)
    two_pi = 2 * math.pi
    return {
        "hour": hour,
        "dayofweek": F.weekday(t),
        "dayofyear": doy,
        "month": F.month(t),
        "year": F.year(t),
        "hour_sin": F.sin(F.lit(two_pi) * hour / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(two_pi) * hour / F.lit(24.0)),
        "dayofyear_sin": F.sin(F.lit(two_pi) * doy / F.lit(365.25)),
        "dayofyear_cos": F.cos(F.lit(two_pi) * doy / F.lit(365.25)),
    }


def month_ranges(start: Column | str, end: Column | str) -> Column:
    """Array of ``struct(range_start, range_end)``: calendar months clipped to [start, end].

    Empty when start > end or either bound is NULL. Explode it to get one row per range.
    """
    s = _c(start).cast("date")
    e = _c(end).cast("date")
    months = F.sequence(F.trunc(s, "MM"), e, F.expr("INTERVAL 1 MONTH"))
    ranges = F.transform(months, lambda m: F.struct(F.greatest(m, s).alias("range_start"),
                                                    F.least(F.last_day(m), e).alias("range_end")))
    return F.when(s <= e, ranges).otherwise(F.array().cast(ranges_type()))


def ranges_type() -> str:
    return "array<struct<range_start:date,range_end:date>>"
