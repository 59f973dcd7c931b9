import json
import os

import pytest
from pyspark.sql import functions as F

from skyframe.operators import windows
from skyframe.operators.cleaning import MissingColumnsError, require_columns
from skyframe.operators.reshape import common_columns, fetch_plan, join_metrics, wide_to_long
from skyframe.session import local_path, scratch_path
from skyframe.sources.files import read_places_json, read_wide_csv, read_wide_metrics


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert require_columns(df, ["a"]) is df
    with pytest.raises(MissingColumnsError):
        require_columns(df, ["a", "c"])


def _write(path, text):
    p = local_path(path)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_wide_csv_spaces_and_coercion(spark):
    root = scratch_path(spark, "t_wide")
    _write(f"{root}/temperature.csv/part.csv",
           "datetime,San Diego,Vancouver\n2012-10-01 13:00:00,280.5,abc\nnot a time,281.0,282.0\n")
    df = read_wide_csv(spark, f"{root}/temperature.csv")
    assert df.columns == ["datetime", "San Diego", "Vancouver"]
    rows = df.orderBy("datetime").collect()
    long = wide_to_long(df, "temperature").where(F.col("datetime").isNotNull()).collect()
    assert {(r.City, r.temperature) for r in long} == {("San Diego", 280.5), ("Vancouver", None)}
    assert rows[0].datetime is None  # unparseable timestamp → NULL (dropped by the join)
    with pytest.raises(FileNotFoundError):
        read_wide_metrics(spark, root)  # the other five files are missing


def test_common_columns_and_join(spark):
    a = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "datetime string, X double, Y double")
    b = spark.createDataFrame([("2024-01-01", 3.0)], "datetime string, Y double")
    assert common_columns({"a": a, "b": b}) == ["Y"]
    row = join_metrics({"a": a, "b": b}).collect()[0]
    assert (row.City, row.a, row.b) == ("Y", 2.0, 3.0)
    c = spark.createDataFrame([("2024-01-01", 3.0)], "datetime string, Z double")
    with pytest.raises(ValueError):
        common_columns({"a": a, "c": c})


def test_places_json_array(spark):
    root = scratch_path(spark, "t_prov")
    _write(f"{root}/p.json", json.dumps([
        {"province_name": "Hà Nội", "latitude": 21.0, "longitude": 105.8},
        {"province_name": "Bad", "latitude": "x", "longitude": 1},
        {"province_name": "NoLon", "latitude": 1.0},
    ], ensure_ascii=False))
    rows = read_places_json(spark, f"{root}/p.json").collect()
    assert [(r.province_name, r.latitude, r.longitude) for r in rows] == [("Hà Nội", 21.0, 105.8)]
    _write(f"{root}/q.json", json.dumps([{"name": "x"}]))
    assert read_places_json(spark, f"{root}/q.json").count() == 0


def test_fetch_plan_counts(spark):
    places = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "province_name string, latitude double, longitude double")
    plan = fetch_plan(places, "2023-12-15", "2024-02-10").collect()
    assert len(plan) == 6
    assert fetch_plan(places, "2024-02-11", "2024-02-10").count() == 0


def test_hot_place_is_split_into_blocks(spark):
    """One place with all rows still spreads over many window partitions."""
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "HOT") for i in range(1000)]
    df = spark.createDataFrame(rows, "obs_id long, datetime timestamp_ntz, City string")
    framed, _ = windows.blocked_frame(df, ["City"], "datetime", back=48, ahead=24, block_rows=100)
    assert framed.where("_home").select("_blk").distinct().count() == 10
    # home rows + trailing halos of all 10 blocks (the last one's lands in an empty block) + 9 leading halos
    assert framed.count() == 1000 + 10 * 48 + 9 * 24
    pos = windows.positions(df, ["City"], "datetime").orderBy("_pos").collect()
    assert [r._pos for r in pos] == list(range(1000)) and [r.obs_id for r in pos] == list(range(1000))


def test_join_metrics_equals_unpivot_then_join(spark):
    a = spark.createDataFrame([("t1", 1.0, 2.0), ("t2", None, 3.0), (None, 9.0, 9.0)], "datetime string, `San Diego` double, Y double")
    b = spark.createDataFrame([("t1", "u", "v"), ("t2", None, "w"), ("t3", "x", "y")], "datetime string, `San Diego` string, Y string")
    got = sorted(join_metrics({"a": a, "b": b}).collect(), key=str)
    long = wide_to_long(a, "a").join(wide_to_long(b, "b"), ["datetime", "City"])
    assert got == sorted(long.select("datetime", "City", "a", "b").collect(), key=str) and len(got) == 4


def test_wide_files_of_the_documented_layout(spark, tmp_path):
    from skyframe.sources.files import read_history_csv, read_wide_metrics
    for name in ("humidity", "pressure", "temperature", "weather_description", "wind_direction", "wind_speed"):
        cell = "light rain" if name == "weather_description" else "1.5"
        (tmp_path / f"{name}.csv").write_text(f"datetime,San Diego\n2012-10-01 12:00:00,{cell}\n")
    wide = read_wide_metrics(spark, str(tmp_path))
    assert wide["weather_condition"].first()["San Diego"] == "light rain" and wide["humidity"].first()["San Diego"] == 1.5
    (tmp_path / "history.csv").write_text(
        "province,datetime,humidity,latitude,longitude,pressure,temperature,weather_condition,wind_direction,wind_speed\n"
        "Bắc Kạn,2024-01-01 10:00:00,50,x,2,1000,280.5,rainy,90,NaN\nB,never,1,1,1,1,1,rainy,1,1\n")
    r = read_history_csv(spark, str(tmp_path / "history.csv")).collect()
    assert len(r) == 1 and r[0].province == "Bắc Kạn" and r[0].latitude is None and r[0].wind_speed is None


def test_broadcast_is_bounded_by_bytes(spark):
    from skyframe.operators.reshape import join_small, measured_bytes
    dim = spark.createDataFrame([("a", "x" * 1000), ("b", None)], "k string, wide string")
    assert 1000 < measured_bytes(dim) < 1300
    fact = spark.createDataFrame([("a",)], "k string")
    def hinted(limit):
        return "rightHint=(strategy=broadcast)" in join_small(fact, dim, "k", max_bytes=limit)._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(2000) and not hinted(100)


def test_coverage_tells_total_from_null_place(spark):
    from skyframe.operators.metrics import coverage
    df = spark.createDataFrame([("A", 1), (None, 2), (None, 5)], "City string, datetime int")
    got = {(r.City, r.is_total): r.n_rows for r in coverage(df, "City").collect()}
    assert got == {("A", False): 1, (None, False): 2, (None, True): 3}
