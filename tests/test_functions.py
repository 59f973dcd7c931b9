import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyframe.functions import (CONDITION_CLASSES, calendar_columns, classify_description, hour_text,
                                kmph_to_mps, month_ranges, parse_timestamp, to_double)


def _one(spark, expr, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


@pytest.mark.parametrize("text,expected", [
    ("Thunderstorm with heavy rain", "thunderstorm"),
    ("Squall", "thunderstorm"),
    ("Light rain and snow", "rainy"),       # rain is checked before snow
    ("Patchy light drizzle", "rainy"),
    ("Light sleet", "snowy"),
    ("Blowing snow", "snowy"),
    ("Partly Cloudy", "cloudy"),
    ("overcast clouds", "cloudy"),
    ("Mist", "foggy"), ("haze", "foggy"), ("Smoke", "foggy"), ("dust storm", "foggy"), ("Fog", "foggy"),
    ("Clear", "sunny"), ("Sunny", "sunny"), ("sky is clear", "sunny"),
    ("Thundery outbreaks possible", "unknown"),  # 'thundery' is not 'thunderstorm'
    ("Blizzard", "unknown"),
    ("", "unknown"),
    (None, "unknown"),
])
def test_classify_rules(spark, text, expected):
    assert _one(spark, classify_description("d"), "d string", [(text,)]) == [expected]


def test_classify_idempotent(spark):
    rows = [(c,) for c in [*CONDITION_CLASSES, "unknown"]]
    out = _one(spark, classify_description(classify_description("d")), "d string", rows)
    assert out == [r[0] for r in rows]


def test_to_double_lenient(spark):
    out = _one(spark, to_double("s"), "s string", [("1.5",), ("abc",), ("NaN",), ("",), (None,)])
    assert out == [1.5, None, None, None, None]


def test_kmph_to_mps(spark):
    out = _one(spark, kmph_to_mps("s"), "s string", [("36",), ("10",), ("abc",)])
    assert out == [10.0, 2.78, None]


def test_hour_text(spark):
    out = _one(spark, hour_text("t"), "t string", [("0",), ("900",), ("2300",), ("100",)])
    assert out == ["00", "09", "23", "01"]


def test_parse_timestamp_lenient(spark):
    out = _one(spark, parse_timestamp("s"), "s string",
               [("2024-01-02 03:00:00",), ("2024-01-02T03:00:00",), ("2024-02-30 10:00:00",), ("junk",)])
    assert out == [dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 3), None, None]


def _ranges(spark, start, end):
    df = spark.createDataFrame([(start, end)], "s date, e date")
    r = df.select(F.explode(month_ranges("s", "e")).alias("r")).select("r.range_start", "r.range_end").collect()
    return [(x[0].isoformat(), x[1].isoformat()) for x in r]


def test_month_ranges(spark):
    d = dt.date
    assert _ranges(spark, d(2024, 3, 5), d(2024, 3, 20)) == [("2024-03-05", "2024-03-20")]
    assert _ranges(spark, d(2023, 12, 15), d(2024, 1, 10)) == [("2023-12-15", "2023-12-31"),
                                                              ("2024-01-01", "2024-01-10")]
    assert _ranges(spark, d(2024, 2, 1), d(2024, 3, 1)) == [("2024-02-01", "2024-02-29"),
                                                           ("2024-03-01", "2024-03-01")]
    assert _ranges(spark, d(2024, 5, 7), d(2024, 5, 7)) == [("2024-05-07", "2024-05-07")]
    assert _ranges(spark, d(2024, 5, 8), d(2024, 5, 7)) == []


def test_calendar_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6),), (dt.datetime(2024, 1, 7, 0),)], "t timestamp_ntz")
    cal = calendar_columns("t")
    rows = df.select(cal["dayofweek"], cal["hour"], cal["dayofyear"], cal["hour_sin"]).collect()
    assert rows[0][0] == 0 and rows[1][0] == 6
    assert rows[0][1] == 6 and rows[0][2] == 1
    assert abs(rows[0][3] - 1.0) < 1e-12


def test_parse_timestamp_strict_fails_on_bad_input(spark):
    from skyframe.functions import parse_timestamp_strict
    ok = _one(spark, parse_timestamp_strict("s"), "s string", [("2024-01-02 03:00:00",)])
    assert ok == [dt.datetime(2024, 1, 2, 3)]
    with pytest.raises(Exception):
        _one(spark, parse_timestamp_strict("s"), "s string", [("junk",)])


def test_previous_day_and_day_slice(spark):
    from skyframe.operators.cleaning import day_slice, previous_day
    assert previous_day("2024-03-01") == dt.date(2024, 2, 29)
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 0),), (dt.datetime(2024, 2, 29, 23, 59),),
                                (dt.datetime(2024, 3, 1, 0),)], "datetime timestamp_ntz")
    assert day_slice(df, previous_day("2024-03-01"), cols=None).count() == 2
