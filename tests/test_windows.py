import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.config import CALENDAR_COLS, LABEL_LAG_COLS, NUMERIC_LAG_COLS, TARGET, WINDOW_COLS
from skyframe.operators import windows
from skyframe.plans import catalog
from skyframe.session import scratch_path

SCHEMA = ("obs_id long, datetime timestamp_ntz, City string, humidity double, pressure double, "
          "temperature double, wind_direction double, wind_speed double, weather_condition string")
LABELS = ["rainy", "sunny", "cloudy"]


def _place(city, n, start_id=0, step_hours=1, gap_at=None):
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(n):
        if gap_at is not None and i == gap_at:
            t += dt.timedelta(hours=10)
        rows.append((start_id + i, t, city, float(i), 1000.0 + i, 280.0 + i % 7, float(i % 360), float(i % 5),
                     LABELS[i % 3]))
        t += dt.timedelta(hours=step_hours)
    return rows


def test_row_counts_72_and_73(spark):
    for strategy in ("blocked", "partition"):
        df72 = spark.createDataFrame(_place("A", 72), SCHEMA)
        df73 = spark.createDataFrame(_place("A", 73), SCHEMA)
        assert windows.forecast_features(df72, strategy=strategy).count() == 0
        out = windows.forecast_features(df73, strategy=strategy).collect()
        assert len(out) == 1 and out[0].obs_id == 48
        assert out[0][TARGET] == LABELS[72 % 3]


def test_two_places_no_leakage(spark):
    rows = _place("A", 80) + _place("B", 80, start_id=1000)
    df = spark.createDataFrame(rows, SCHEMA)
    lags = windows.add_lags(df, block_rows=60).collect()
    first_b = [r for r in lags if r.obs_id == 1000][0]
    assert first_b.humidity_lag_1h is None
    second_b = [r for r in lags if r.obs_id == 1001][0]
    assert second_b.humidity_lag_1h == 0.0


def test_gap_uses_row_offsets(spark):
    df = spark.createDataFrame(_place("A", 10, gap_at=5), SCHEMA)
    r = [x for x in windows.add_lags(df).collect() if x.obs_id == 5][0]
    assert r.humidity_lag_1h == 4.0  # previous row, 11 hours earlier


def test_blocked_equals_partition_with_tiny_blocks(spark):
    """Block size at its minimum (back + ahead = 72) forces many blocks and halos."""
    clean = catalog.cleaned_obs(spark, "/root/testdata/sf0.001")
    cols = ["obs_id", TARGET, *NUMERIC_LAG_COLS, *LABEL_LAG_COLS, *WINDOW_COLS, *CALENDAR_COLS]
    a = windows.forecast_features(clean, block_rows=72).select(*cols).collect()
    b = windows.forecast_features(clean, strategy="partition").select(*cols).collect()
    assert len(a) == len(b) > 0
    assert sorted(map(tuple, a), key=lambda t: t[0]) == sorted(map(tuple, b), key=lambda t: t[0])


def test_rolling_means_match_pandas(spark):
    rows = _place("A", 120)
    # knock out some values so min_periods matters
    rows = [r if i % 11 else (*r[:3], None, *r[4:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = windows.add_rolling_means(df, cols=["humidity"], block_rows=60).orderBy("obs_id").toPandas()
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for w in (6, 12, 24, 48):
        exp = pdf["humidity"].shift(1).rolling(window=w, min_periods=max(1, int(w * 0.5))).mean()
        col = f"humidity_win_{w}h_mean"
        diff = (got[col].astype(float) - exp).abs().max()
        assert got[col].isna().equals(exp.isna()), col
        assert diff < 1e-9 or pd.isna(diff), col


def test_forecast_row_count_property(spark):
    """rows out = Σ max(0, n_place − 72) over cleaned rows."""
    clean = catalog.cleaned_obs(spark, "/root/testdata/sf0.001")
    per = clean.groupBy("City").count().collect()
    expected = sum(max(0, r["count"] - 72) for r in per)
    assert windows.forecast_features(clean).count() == expected


def test_single_window_operator(spark):
    clean = catalog.cleaned_obs(spark, "/root/testdata/sf0.001")
    plan = windows.forecast_features(clean)._jdf.queryExecution().optimizedPlan().toString()
    operators = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window [")]
    # one for the features (lead, lags and means), one over the small counts table
    assert len(operators) == 2
    assert sum("lead(" in line and "lag(" in line for line in operators) == 1
    assert sum("_n" in line and "_range" in line for line in operators) == 1
    assert "events.parquet" not in plan  # the input was scanned once, into sorted ranges


def test_one_place_and_day_is_many_tasks(spark, monkeypatch):
    """All rows in one place and one day: the ranges still share the work evenly."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(40_000).select(F.col("id").alias("obs_id"), F.lit("A").alias("City"),
                                      F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("datetime"))
    path = scratch_path(spark, "t_ranges")
    monkeypatch.setattr(windows, "scratch_path", lambda *_: path)
    pos = windows.positions(rows, ["City"], "datetime")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == n and max(sizes) < 2 * 40_000 / n
    assert pos.where("_pos <> obs_id").count() == 0


def test_null_place_and_time_are_kept(spark):
    rows = _place("A", 5) + [(90, None, "A", *([1.0] * 5), "sunny"), *[(91 + i, r[1], None, *r[3:]) for i, r in enumerate(_place("A", 3))]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {s: sorted((r.obs_id, r.humidity_lag_1h) for r in windows.add_lags(df, strategy=s).collect()) for s in ("blocked", "partition")}
    assert len(got["blocked"]) == len(rows) and got["blocked"] == got["partition"]


def test_equal_order_is_an_error(spark):
    rows = _place("A", 5) + [(99, *_place("A", 5)[2][1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    for strategy in ("blocked", "partition"):
        with pytest.raises(Exception, match="equal in order"):
            windows.add_lags(df, strategy=strategy).collect()
    assert windows.add_lags(df, tiebreak=["obs_id"]).count() == 6


@pytest.fixture()
def shared_times(spark, tmp_path):
    """A folder of events in which two of a station share each time, and one row comes twice."""
    start = dt.datetime(2024, 1, 1)
    rows = [(12 * i + i % 6, start + dt.timedelta(hours=i // 2), 7 + 10 * (i % 2), "view", float(i % 50), "{}") for i in range(240)]
    rows.append(rows[100])
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(7, "seven", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_queries_order_equal_times_by_key(spark, shared_times):
    got = [r.asDict() for r in catalog.q_lag_features(spark, shared_times).orderBy("datetime", "obs_id").collect()]
    rows = catalog.cleaned_obs(spark, shared_times).orderBy("datetime", "obs_id").collect()
    assert len(got) == len(rows) == 241
    for i, r in enumerate(got):
        for k in (1, 48):
            assert r[f"humidity_lag_{k}h"] == (rows[i - k].humidity if i >= k else None)
            assert r[f"weather_condition_lag_{k}h"] == (rows[i - k].weather_condition if i >= k else None)
    lead = catalog.q_lead_target(spark, shared_times).orderBy("datetime", "obs_id").collect()
    assert [r[TARGET] for r in lead] == [r.weather_condition for r in rows[24:]]
    means = catalog.q_rolling_means(spark, shared_times).orderBy("datetime", "obs_id").collect()
    assert abs(means[-1]["humidity_win_6h_mean"] - sum(r.humidity for r in rows[-7:-1]) / 6) < 1e-6
    framed = catalog.q_forecast_features(spark, shared_times)
    assert framed.count() == 241 - 72 == catalog.q_encode_labels(spark, shared_times).count()
    decoded = catalog.q_decode_labels(spark, shared_times)
    assert framed.select("obs_id", TARGET).exceptAll(decoded).isEmpty()
    assert catalog.q_label_domain(spark, shared_times).count() == 6


def test_cleaned_rows_of_one_file_are_many_tasks(spark, shared_times, tmp_path):
    """Rows in one row group are cleaned by several tasks, and once: what orders them reads them twice."""
    one = tmp_path / "one"
    few = spark.read.parquet(f"{shared_times}/events.parquet").select("ts", "user_id", "event_type", "value", "props").limit(20)
    spark.range(1500).withColumnRenamed("id", "event_id").crossJoin(few).coalesce(1).write.parquet(f"{one}/events.parquet")
    rows, _ = catalog._ordered_obs(spark, str(one))
    assert not rows.exceptAll(catalog.cleaned_obs(spark, str(one))).count() and rows.count() == 22_500
    assert len(rows.inputFiles()) == min(spark.sparkContext.defaultParallelism, 3)
    assert not any("events.parquet" in f for f in rows.inputFiles())


def test_forecaster_takes_equal_times(spark, shared_times):
    rows, labels = catalog._forecast_rows(spark, shared_times)
    assert rows.count() == 241 - 72 and len(labels) == 6


def test_exact_time_features_on_gappy_data(spark):
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from skyframe.operators import windows
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(p, start + dt.timedelta(hours=h), float(rng.randrange(50)), rng.choice(["sunny", "rainy"]))
            for p in ("A", "B") for h in range(400) if rng.random() < 0.7]
    rows.append(("A", None, 1.0, "sunny"))
    df = spark.createDataFrame(rows, "City string, datetime timestamp_ntz, humidity double, weather_condition string")
    out = windows.exact_time_features(df, cols=("humidity", "weather_condition"), lag_steps=(1, 48), window_sizes=(6,), block_hours=48)
    at = {(p, t): (v, c) for p, t, v, c in rows}
    got = out.collect()
    assert len(got) == len(rows) - 1
    for r in got:
        def back(h):
            return at.get((r.City, r.datetime - dt.timedelta(hours=h)), (None, None))
        assert (r.humidity_lag_1h, r.weather_condition_lag_1h) == back(1) and r.humidity_lag_48h == back(48)[0]
        assert r.target_weather_condition_24h == back(-24)[1]
        seen = [v for v in (back(h)[0] for h in range(1, 7)) if v is not None]
        want = sum(seen) / len(seen) if len(seen) >= 3 else None
        mean = r[windows.window_name("humidity", 6)]
        assert (mean is None) == (want is None) and (want is None or abs(mean - want) < 1e-9)
    twice = df.unionByName(df.where("City = 'A'").limit(1))
    with pytest.raises(Exception, match="equal in order"):
        windows.exact_time_features(twice, cols=("humidity", "weather_condition"), lag_steps=(1,), window_sizes=(6,)).select(F.count("City")).collect()
    with pytest.raises(ValueError):
        windows.exact_time_features(df, block_hours=10)
