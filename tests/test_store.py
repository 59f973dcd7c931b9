import datetime as dt

from pyspark.sql import functions as F

from skyframe.config import STORE_COLS
from skyframe.operators.store import (create_history, last_wins, merge_day_into_base, merge_day_into_history, upsert,
                                      upsert_counts, upsert_into_store)
from skyframe.session import scratch_path
from skyframe.sources.files import read_store, write_store

SCHEMA = ("datetime timestamp_ntz, province string, humidity double, latitude double, longitude double, "
          "pressure double, temperature double, weather_condition string, wind_direction double, "
          "wind_speed double, seq long")


def _row(h, p, temp, seq=0, cond="rainy"):
    return (dt.datetime(2024, 1, 1, h), p, 50.0, 1.0, 2.0, 1000.0, temp, cond, 90.0, 3.0, seq)


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _as_map(df):
    return {(r.datetime.hour, r.province): r.temperature for r in df.collect()}


def test_upsert_cases_and_counts(spark):
    target = _df(spark, [_row(0, "A", 1.0), _row(1, "A", 2.0), _row(2, "A", 3.0), _row(3, "A", 4.0)]).drop("seq")
    batch = _df(spark, [
        _row(0, "A", 1.0, 1),        # unchanged
        _row(1, "A", 20.0, 1),       # change
        _row(2, "A", None, 1),       # NULL overwrites
        _row(5, "B", 7.0, 1),        # insert
        _row(5, "B", 8.0, 2),        # duplicate key: larger seq wins
        _row(6, None, 9.0, 1),       # NULL key skipped
    ])
    out = upsert(target, batch)
    assert _as_map(out) == {(0, "A"): 1.0, (1, "A"): 20.0, (2, "A"): None, (3, "A"): 4.0, (5, "B"): 8.0}
    c = upsert_counts(target, batch).collect()[0].asDict()
    assert c == {"inserted": 1, "matched": 3, "modified": 2, "skipped": 1, "saved": 3}
    twice = upsert(out, batch)
    assert _as_map(twice) == _as_map(out)


def test_upsert_leaves_absent_fields(spark):
    target = _df(spark, [_row(0, "A", 1.0)]).drop("seq")
    partial = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0), "A", 9.0, 1)],
                                    "datetime timestamp_ntz, province string, temperature double, seq long")
    r = upsert(target, partial).collect()[0]
    assert r.temperature == 9.0 and r.humidity == 50.0 and r.weather_condition == "rainy"


def test_merge_day_cases(spark):
    empty = _df(spark, [])
    store = _df(spark, [_row(0, "A", 1.0, 1), _row(0, "A", 2.0, 2), _row(1, "B", 3.0, 3)])
    merged = merge_day_into_base(empty, store, "2024-01-01")
    assert _as_map(merged) == {(0, "A"): 2.0, (1, "B"): 3.0}
    base = _df(spark, [_row(0, "A", 5.0, 9), _row(4, "C", 6.0, 1)])
    merged = merge_day_into_base(base, store, "2024-01-01")
    assert _as_map(merged) == {(0, "A"): 2.0, (1, "B"): 3.0, (4, "C"): 6.0}  # store beats base
    absent = merge_day_into_base(base, store, "2024-01-05")
    assert _as_map(absent) == _as_map(base)
    again = merge_day_into_base(merged, store, "2024-01-01")
    assert _as_map(again) == _as_map(merged)


def test_persisted_upsert_idempotent(spark):
    path = scratch_path(spark, "t_store")
    write_store(_df(spark, [_row(0, "A", 1.0), _row(1, "A", 2.0)]), path)
    batch = _df(spark, [_row(1, "A", 20.0, 1), _row(2, "B", 3.0, 1), _row(3, None, 1.0, 1)])
    c1 = upsert_into_store(spark, path, batch, scratch_path(spark, "t_stage"))
    assert c1 == {"inserted": 1, "matched": 1, "modified": 1, "skipped": 1, "saved": 2}
    first = _as_map(read_store(spark, path))
    c2 = upsert_into_store(spark, path, batch, scratch_path(spark, "t_stage"))
    assert c2["inserted"] == 0 and c2["modified"] == 0 and c2["matched"] == 2
    assert _as_map(read_store(spark, path)) == first == {(0, "A"): 1.0, (1, "A"): 20.0, (2, "B"): 3.0}
    assert read_store(spark, path).columns == STORE_COLS


def test_store_day_pruning(spark):
    path = scratch_path(spark, "t_store_prune")
    write_store(_df(spark, [_row(0, "A", 1.0)]), path)
    plan = read_store(spark, path, days=[dt.date(2024, 1, 1)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan
    empty = read_store(spark, scratch_path(spark, "t_absent"))
    assert empty.count() == 0 and empty.columns == STORE_COLS
    assert read_store(spark, path).where(F.col("province") == "A").count() == 1


def _on(day, h, p, temp, seq=1, humidity=50.0):
    return (dt.datetime(2024, 1, day, h), p, humidity, 1.0, 2.0, 1000.0, temp, "rainy", 90.0, 3.0, seq)


def test_reused_staging_root_does_not_bring_back_old_days(spark):
    path, a, b = (scratch_path(spark, n) for n in ("t_rev", "t_stage_a", "t_stage_b"))
    upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 1.0)]), a)
    upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 99.0)]), b)
    counts = upsert_into_store(spark, path, _df(spark, [_on(2, 0, "A", 5.0)]), a)
    assert counts["inserted"] == 1 and counts["saved"] == 1
    got = {(r.datetime.day, r.temperature) for r in read_store(spark, path).collect()}
    assert got == {(1, 99.0), (2, 5.0)}


def test_nan_becomes_null_in_the_store(spark):
    nan = float("nan")
    batch = _df(spark, [_on(1, 0, "A", nan, humidity=nan)])
    assert upsert(_df(spark, []).drop("seq"), batch).first().temperature is None
    path = scratch_path(spark, "t_nan")
    upsert_into_store(spark, path, batch, scratch_path(spark, "t_nan_stage"))
    r = read_store(spark, path).first()
    assert r.temperature is None and r.humidity is None and r.pressure == 1000.0


def test_persisted_day_merge_touches_one_day(spark):
    path, staging = scratch_path(spark, "t_hist"), scratch_path(spark, "t_hist_stage")
    create_history(_df(spark, [_on(1, 0, "A", 1.0, 1), _on(1, 0, "A", 2.0, 2), _on(2, 0, "A", 3.0, 3)]), path)
    files = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).where("day = '2024-01-01'").distinct().collect()}
    today = _df(spark, [_on(2, 0, "A", 30.0, 1), _on(2, 1, "B", 4.0, 2), _on(1, 0, "A", -1.0, 9)])
    for _ in range(2):  # twice = once
        merge_day_into_history(spark, path, today, "2024-01-02", staging)
        got = {(r.datetime.day, r.datetime.hour, r.province): r.temperature for r in read_store(spark, path).collect()}
        assert got == {(1, 0, "A"): 2.0, (2, 0, "A"): 30.0, (2, 1, "B"): 4.0}
    again = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).where("day = '2024-01-01'").distinct().collect()}
    assert again == files


def test_last_wins_limits_before_the_shuffle(spark):
    plan = last_wins(_df(spark, [_on(1, 0, "A", 1.0)]), ["datetime", "province"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2


def test_stream_ties_replays_and_new_checkpoints(spark):
    import json

    from skyframe.streaming.ingest import ingest_stream
    def payload(temp):
        hour = {"time": "300", "humidity": "50", "pressure": "1000", "tempC": str(temp), "winddirDegree": "1", "windspeedKmph": "1",
                "weatherDesc": [{"value": "Light rain"}]}
        return json.dumps({"data": {"weather": [{"date": "2024-01-01", "hourly": [hour]}]}})
    landing, path, staging = (scratch_path(spark, n) for n in ("t_land", "t_stream", "t_stream_stage"))
    rows = [("A", 1.0, 2.0, 2, payload(20)), ("A", 1.0, 2.0, 1, payload(10))]  # one key, one file
    spark.createDataFrame(rows, "province string, latitude double, longitude double, record long, payload string").coalesce(1).write.json(landing)
    for _ in range(2):
        ingest_stream(spark, landing, path, scratch_path(spark, "t_ckpt"), staging).awaitTermination()
        assert [r.temperature for r in read_store(spark, path).collect()] == [293.15]
    # a later file, then a full replay from a new checkpoint through the same staging root
    import time
    time.sleep(1.1)
    spark.createDataFrame([("A", 1.0, 2.0, 1, payload(30))], "province string, latitude double, longitude double, record long, payload string").coalesce(1).write.mode("append").json(landing)
    ingest_stream(spark, landing, path, scratch_path(spark, "t_ckpt"), staging).awaitTermination()
    assert [r.temperature for r in read_store(spark, path).collect()] == [303.15]
