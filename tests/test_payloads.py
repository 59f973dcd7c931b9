import datetime as dt
import json

from skyframe.sources.payloads import parse_current, parse_history


def _hist(spark, docs):
    rows = [(json.dumps(d) if not isinstance(d, str) else d, "P", 1.0, 2.0) for d in docs]
    df = spark.createDataFrame(rows, "payload string, province string, latitude double, longitude double")
    return parse_history(df).orderBy("datetime").collect()


def _hour(time, **kw):
    h = {"time": time, "humidity": "80", "pressure": "1010", "tempC": "20", "winddirDegree": "90",
         "windspeedKmph": "36", "weatherDesc": [{"value": "Light rain"}]}
    h.update(kw)
    return {k: v for k, v in h.items() if v is not None}


def test_history_normal_and_hours(spark):
    doc = {"data": {"weather": [{"date": "2024-01-02",
                                 "hourly": [_hour("0"), _hour("900"), _hour("2300")]}]}}
    rows = _hist(spark, [doc])
    assert [r.datetime for r in rows] == [dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 2, 9),
                                          dt.datetime(2024, 1, 2, 23)]
    r = rows[0]
    assert r.temperature == 293.15 and r.wind_speed == 10.0 and r.weather_condition == "rainy"
    assert r.province == "P" and r.latitude == 1.0 and r.longitude == 2.0


def test_history_missing_parts(spark):
    assert _hist(spark, [{"nodata": 1}]) == []
    assert _hist(spark, [{"data": {}}]) == []
    assert _hist(spark, ["not json"]) == []
    doc = {"data": {"weather": [{"date": "2024-01-02"},  # day without hourly
                                {"date": "2024-01-03", "hourly": [_hour(None), _hour("100")]}]}}
    rows = _hist(spark, [doc])
    assert [r.datetime for r in rows] == [dt.datetime(2024, 1, 3, 1)]


def test_history_bad_fields_become_null(spark):
    doc = {"data": {"weather": [{"date": "2024-01-02", "hourly": [
        _hour("100", windspeedKmph="abc"),
        _hour("200", weatherDesc=None),
        _hour("300", weatherDesc=[]),
        _hour("2400"),
    ]}]}}
    rows = _hist(spark, [doc])
    assert len(rows) == 3  # hour 24 is not a valid time
    assert rows[0].wind_speed is None and rows[0].humidity == 80.0
    assert rows[1].weather_condition == "unknown" and rows[2].weather_condition == "unknown"


def _cur(spark, docs):
    rows = [(i, json.dumps(d), 10.0, 106.0) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id int, payload string, latitude double, longitude double")
    return parse_current(df, keep=("id",)).orderBy("id").collect()


def test_current_payloads(spark):
    cond = {"temp_C": "30", "humidity": "70", "pressure": "1008", "windspeedKmph": "18",
            "winddirDegree": "180", "observation_time": "09:00 AM", "weatherDesc": [{"value": "Sunny"}]}
    docs = [
        {"data": {"current_condition": [cond]}},
        {"data": {"current_condition": []}},
        {"data": {"current_condition": [{**cond, "weatherDesc": [{"value": None}]}]}},
        {"data": {"current_condition": [{**cond, "humidity": "x", "weatherDesc": [{"value": ""}]}]}},
    ]
    rows = _cur(spark, docs)
    assert [r.id for r in rows] == [0, 2, 3]
    assert rows[0].temperature_kelvin == 303.15 and rows[0].wind_speed_mps == 5.0
    assert rows[0].weather_condition == "sunny"
    assert rows[1].weather_condition == "unknown"
    assert rows[2].humidity is None and rows[2].weather_condition == "unknown"
