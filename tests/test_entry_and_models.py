import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from skyframe.config import FEATURES, LABEL, LAG_STEPS, METRICS, WINDOW_SIZES
from skyframe.operators import encoding, forecast, modeling, sampling
from skyframe.plans import catalog, oracles
from skyframe.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_weather_condition_24h" in df.columns


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.queries()) == set(oracles.oracle_sql())  # every core query is checked


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in ["events", "nation", "orders", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    srows = sorted(tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
    drows = sorted(tuple(_norm(dict(zip(dcols, r))[c]) for c in sorted(dcols)) for r in cur.fetchall())
    assert srows == drows


def _norm(v):
    if isinstance(v, float):
        v = round(v, 6)
        return "0.0" if v == 0 else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def test_resolve_params():
    p, ignored = modeling.resolve_params({"lambda": 2, "alpha": None, "bogus": 1, "n_estimators": 5, "booster": "dart",
                                          "learning_rate": 0.3})
    assert p["n_estimators"] == 5 and "reg_lambda" not in p and "booster" not in p
    assert sorted(ignored) == ["alpha", "bogus", "booster", "lambda", "learning_rate"]
    p, ignored = modeling.resolve_params({"learning_rate": 0.3, "max_depth": 4}, algorithm="gbt_ovr")
    assert p["learning_rate"] == 0.3 and p["max_depth"] == 4 and ignored == []
    assert modeling.resolve_params({"max_depth": 4}, algorithm="mlp")[1] == ["max_depth"]
    for bad in ({"subsample": 1.5}, {"booster": "linear"}, {"max_depth": 0}, {"max_depth": 50},
                {"min_child_weight": 0.5}, {"n_estimators": 0}, {"learning_rate": 0}):
        with pytest.raises(ValueError):
            modeling.resolve_params(bad)


def _model(spark, algorithm="random_forest"):
    tt = catalog.training_table(spark, SF)
    sp = sampling.stratified_split(tt, LABEL, "obs_id")
    train = sp.where("split = 'train'")
    labels = encoding.fit_labels(tt, [LABEL])
    stats = encoding.fit_scaler(train, FEATURES)
    params, _ = modeling.resolve_params({"n_estimators": 2 if algorithm == "gbt_ovr" else 5, "max_depth": 3}, algorithm=algorithm)
    return modeling.train_classifier(train, labels, stats, params, algorithm), sp


def test_model_roundtrip_and_missing_features(spark):
    model, sp = _model(spark)
    root = scratch_path(spark, "t_models")
    p1 = modeling.save_model(model, root)
    p2 = modeling.save_model(model, root)
    assert p1.endswith("v=1") and p2.endswith("v=2")
    loaded = modeling.load_latest(root)
    req = sp.withColumn("humidity", F.when(F.col("obs_id") % 5 == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("humidity")))
    a = modeling.score(model, req, keep=["obs_id"])
    b = modeling.score(loaded, req, keep=["obs_id"])
    assert a.count() == req.count()
    assert a.exceptAll(b).count() == 0
    missing = a.where("status = 'missing_features'")
    assert missing.count() == req.where("obs_id % 5 = 0").count()
    assert missing.where("prediction IS NOT NULL").count() == 0


def test_classify_or_predict_sources(spark):
    model, _ = _model(spark)
    rows = [(1, 50.0, 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, "sunny"),
            (2, 50.0, 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, "unknown"),
            (3, None, 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, "unknown"),
            (4, 50.0, 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, None),
            (5, None, 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, None),
            (6, float("inf"), 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, "unknown"),
            (7, float("inf"), 1000.0, 290.0, 10.0, 2.0, 1.5, 100.5, "rainy")]
    df = spark.createDataFrame(rows, "id int, humidity double, pressure double, temperature double, "
                                     "wind_direction double, wind_speed double, latitude double, longitude double, "
                                     "weather_condition string")
    found = modeling.classify_or_predict(df, model).collect()
    out = {r.id: r for r in found}
    assert len(found) == len(rows)  # no row is lost, NULL classes included
    assert out[4].condition_source == "predicted (fallback)" and out[4].weather_condition != "unknown"
    assert out[5].condition_source.endswith("missing features)") and out[5].weather_condition == "unknown"
    assert out[6].condition_source.endswith("prediction error)") and out[6].weather_condition == "unknown"
    assert out[7].condition_source == "api" and out[7].weather_condition == "rainy"
    root = scratch_path(spark, "t_latest")
    none = {r.id: (r.condition_source, r.weather_condition) for r in modeling.classify_or_predict_latest(df, root).collect()}
    failed = ("api (prediction fallback failed - exception)", "unknown")
    assert none[2] == none[4] == failed and none[1] == ("api", "sunny") and none[5][0].endswith("missing features)")
    modeling.save_model(model, root)
    some = {r.id: r.condition_source for r in modeling.classify_or_predict_latest(df, root).collect()}
    assert some == {i: r.condition_source for i, r in out.items()}
    assert out[1].condition_source == "api" and out[1].weather_condition == "sunny"
    assert out[2].condition_source == "predicted (fallback)" and out[2].weather_condition != "unknown"
    assert out[3].condition_source.startswith("api (prediction fallback failed") and out[3].weather_condition == "unknown"


def test_mlp_warm_start(spark):
    day = F.dayofmonth("datetime")
    model, _ = _model(spark, "mlp")
    tt = catalog.training_table(spark, SF)
    upd = modeling.train_incremental(model, tt.where(day == 21), {"n_estimators": 3}, classify_label=False)
    assert modeling.model_labels(upd) == modeling.model_labels(model)
    assert modeling.scaler_of(upd) == modeling.scaler_of(model)
    before, after = model.stages[2].weights.toArray(), upd.stages[2].weights.toArray()
    assert before.shape == after.shape and (before != after).any()


def test_tree_models_need_history_to_continue(spark):
    tt = catalog.training_table(spark, SF)
    day = F.dayofmonth("datetime")
    for algorithm in ("random_forest", "gbt_ovr"):
        model, _ = _model(spark, algorithm)
        with pytest.raises(ValueError, match="history"):
            modeling.train_incremental(model, tt.where(day == 21), classify_label=False)
        upd = modeling.train_incremental(model, tt.where(day == 21), {"n_estimators": 2, "max_depth": 2}, classify_label=False,
                                         history=tt.where(day <= 21))
        assert modeling.model_algorithm(upd) == algorithm
        assert modeling.scaler_of(upd) == modeling.scaler_of(model)
        assert modeling.score(upd, tt).where("prediction is not null").count() == tt.count()


def test_half_written_versions_are_not_loaded(spark):
    model, sp = _model(spark)
    root = scratch_path(spark, "t_half")
    first = modeling.save_model(model, root)
    model.stages[0].write().save(f"{root}/v=2/stages/0_part")  # a writer that died
    spark.createDataFrame([("{}",)], "value string").write.text(f"{root}/v=2/metadata")
    loaded = modeling.load_latest(root)
    assert first.endswith("v=1") and modeling.scaler_of(loaded) == modeling.scaler_of(model)
    assert modeling.save_model(model, root).endswith("v=3")
    modeling._create(spark, f"{root}/_claims/4", "another writer")
    assert modeling.save_model(model, root).endswith("v=5")


def test_retrain_job_outcomes(spark):
    tt = catalog.training_table(spark, SF)
    root = scratch_path(spark, "t_job")
    small = {"n_estimators": 3, "max_depth": 3}
    row, report = modeling.retrain_job(spark, tt, "obs_id", root, overrides={**small, "lambda": 1}, classify_label=False,
                                       balance=True)
    r = row.first()
    assert r.status == "completed" and r.version == "v=1" and r.n_train + r.n_test == tt.count()
    assert r.ignored_params == ["lambda"] and r.params_used["max_depth"] == "3" and r.start_time <= r.end_time
    assert 0 <= r.accuracy <= 1 and r.log_loss > 0 and report.where("label = 'macro avg'").count() == 1
    bad = modeling.retrain_job(spark, tt.where("false"), "obs_id", root, overrides=small, classify_label=False)[0].first()
    assert bad.status == "failed" and "no usable" in bad.message and bad.version is None
    wrong = modeling.retrain_job(spark, tt, "obs_id", root, overrides={"max_depth": 99}, classify_label=False)[0].first()
    assert wrong.status == "failed" and "max_depth" in wrong.message
    assert modeling.load_latest(root) is not None
    stored = modeling.job_results(spark, root).orderBy("start_time").collect()
    assert [x.status for x in stored] == ["completed", "failed", "failed"] and stored[0] == r
    wanted = report.select("label", "precision", "recall", "f1", "support").collect()
    assert sorted(map(tuple, wanted)) == sorted(map(tuple, stored[0].classification_report))
    assert modeling.job_report(spark, root, "v=1").count() == len(wanted) and modeling.job_report(spark, root, "v=9").count() == 0
    assert modeling.job_results(spark, scratch_path(spark, "t_no_job")).count() == 0


def test_forecaster_trains_on_balanced_rows(spark):
    from skyframe.config import FORECAST_FEATURES, TARGET
    from skyframe.operators import forecast
    rows, labels = catalog._forecast_rows(spark, "/root/testdata/sf0.01")
    assert len(FORECAST_FEATURES) == 72 == len(rows.columns) - 4
    model, report = forecast.train_forecast(rows, labels, {"n_estimators": 3, "max_depth": 3})
    assert modeling.model_features(model) == FORECAST_FEATURES
    total = report.where("label = 'macro avg'").first().support
    assert total == rows.where("split = 'test'").count()
    sizes = {r["count"] for r in forecast.balanced_train(rows).groupBy(TARGET).count().collect()}
    assert len(sizes) == 1


def test_log_loss_clips_and_skips(spark):
    from skyframe.operators import metrics
    df = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [1.0, 0.0]), ("c", [0.5, 0.5]), (None, [0.5, 0.5])], "y string, p array<double>")
    r = metrics.log_loss(df, "y", "p", ["a", "b"]).first()
    import math
    assert r.n == 2 and abs(r.log_loss - (math.log(2) + 52 * math.log(2)) / 2) < 1e-9


def test_rows_of_one_file_are_many_tasks(spark, tmp_path, monkeypatch):
    """Training rows in one row group are dealt evenly; what a task keeps is bounded."""
    from pyspark.sql import functions as F

    from skyframe import session

    path = f"{tmp_path}/one"
    spark.range(60_000).select(F.col("id").alias("obs_id"), *[(F.col("id") % 7).cast("double").alias(c) for c in FEATURES],
                               F.lit("sunny").alias(LABEL)).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    cores = min(spark.sparkContext.defaultParallelism, 6)

    def sizes(df):
        return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]

    assert sizes(rows) == [60_000]
    assert len(sizes(session.spread(rows))) == cores and max(sizes(session.spread(rows))) <= 60_000 / cores + 10
    params, _ = modeling.resolve_params({"n_estimators": 200})
    dealt = modeling._dealt(rows, FEATURES, LABEL, params, "random_forest")
    assert len(sizes(dealt)) == cores and dealt.columns == [*FEATURES, LABEL]
    monkeypatch.setattr(modeling, "TASK_BYTES", 2_000_000)
    many = sizes(modeling._dealt(rows, FEATURES, LABEL, params, "random_forest"))
    assert sum(many) == 60_000 and max(many) < 2_100
    assert dealt.select(FEATURES[0]).exceptAll(rows.select(FEATURES[0])).isEmpty()


def _own_rows(spark, n=400):
    """Hourly rows of one place with three classes; features follow the key."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("obs_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("datetime"),
        F.lit("here").alias("City"), *[((i * (k + 3)) % 17).cast("double").alias(c) for k, c in enumerate(METRICS)],
        F.lit(1.5).alias("latitude"), F.lit(100.5).alias("longitude"),
        F.when(i % 3 == 0, "rainy").when(i % 5 == 0, "foggy").otherwise("sunny").alias(LABEL))


def test_a_retrain_scores_its_test_rows_once(spark, monkeypatch):
    calls, transform = [], modeling.PipelineModel.transform
    monkeypatch.setattr(modeling.PipelineModel, "transform", lambda m, df: calls.append(1) or transform(m, df))
    model, report, done = modeling.retrain(spark, _own_rows(spark), "obs_id", {"n_estimators": 3, "max_depth": 3})
    assert len(calls) == 1
    split = sampling.stratified_split(_own_rows(spark), LABEL, "obs_id").where("split = 'test'")
    alone = modeling.evaluate_log_loss(model, split).first()
    assert abs(done["log_loss"] - alone["log_loss"]) < 1e-9 and alone["n"] == done["n_test"]
    assert sorted(report.collect()) == sorted(modeling.evaluate(model, split).collect())


def test_a_days_update_makes_its_training_rows_once(spark, monkeypatch):
    made, rows = [], _own_rows(spark)
    monkeypatch.setattr(catalog, "training_rows", lambda *_: made.append(1) or rows)
    monkeypatch.setitem(modeling.DEFAULT_PARAMS, "n_estimators", 3)
    row = catalog.q_train_incremental(spark, "unused").first()
    assert len(made) == 1 and row["n_day"] == 400 % 24 and row["classes"] == "foggy,rainy,sunny"


def test_the_split_of_forecast_rows_encodes_no_column_again(spark):
    located = _own_rows(spark).withColumnsRenamed({"latitude": "Latitude", "longitude": "Longitude"})
    rows, labels = forecast.forecast_rows(located)
    assert labels == ["foggy", "rainy", "sunny"] and rows.count() == 400 - 24 - max(*LAG_STEPS, *WINDOW_SIZES)
    assert "UDF" not in rows._jdf.queryExecution().optimizedPlan().toString()
