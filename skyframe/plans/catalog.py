"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

A query = fixture input (``fixtures``) → library operators → output projection,
with doubles rounded to 8 decimals so results compare exactly with the oracle.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..config import (CALENDAR_COLS, CITY, FEATURES, FORECAST_FEATURES, LABEL, LABEL_LAG_COLS, METRICS, NUMERIC_LAG_COLS,
                      SOURCE_API, STORE_COLS, TARGET, TARGET_ENCODED, UNKNOWN, WINDOW_COLS)
from ..functions.conditions import CONDITION_CLASSES, classify_description
from ..functions.scalars import celsius_to_kelvin, kmph_to_mps, parse_timestamp, to_double
from ..operators import boosting, cleaning, encoding, forecast, metrics, modeling, reshape, sampling, store, windows
from ..session import materialise
from ..sources import files, payloads, snapshots
from ..streaming import ingest, scoring
from . import fixtures as fx

DECIMALS = 8
Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def cleaned_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.obs(spark, sf_dir)
    return cleaning.clean_observations(o, description="weather_description").drop("weather_description")


def _dealt_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_observations(fx.spread_obs(spark, sf_dir), description="weather_description")
    return clean.drop("weather_description")


def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cleaned_obs`` for steps over rows in order: dealt evenly to tasks, and written once, as sorting
    into ranges reads its input twice."""
    return materialise(_dealt_obs(spark, sf_dir), "cleaned-rows")


def _located(clean: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = reshape.join_places(clean, fx.places(spark, sf_dir))
    return joined.select("obs_id", "datetime", CITY, *METRICS, F.col("Latitude").alias("latitude"),
                         F.col("Longitude").alias("longitude"), LABEL)


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned observations with coordinates, model features named as in the store."""
    return _located(cleaned_obs(spark, sf_dir), spark, sf_dir)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table for the steps of a training or of scoring: dealt evenly to tasks, and written
    once, as they read it several times."""
    return materialise(_located(_dealt_obs(spark, sf_dir), spark, sf_dir), "training-rows")


CLEAN_COLS = ["obs_id", "datetime", CITY, *METRICS, LABEL]
FORECAST_COLS = ["obs_id", "datetime", CITY, *METRICS, LABEL, TARGET, *NUMERIC_LAG_COLS, *LABEL_LAG_COLS,
                 *WINDOW_COLS, *CALENDAR_COLS]


# ---------------------------------------------------------------------------
# Observation queries
# ---------------------------------------------------------------------------

def q_classify_description(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    return o.select("obs_id", "weather_description", classify_description("weather_description").alias(LABEL))


def q_clean_observations(spark, sf_dir):
    return round_doubles(cleaned_obs(spark, sf_dir).select(*CLEAN_COLS))


def q_cleaning_audit(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    return cleaning.cleaning_audit(o, description="weather_description")


def q_select_features(spark, sf_dir):
    return round_doubles(training_table(spark, sf_dir).select("obs_id", *FEATURES))


def _ordered_obs(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Cleaned observations, and what orders those of a station that share their time."""
    clean = cleaned_rows(spark, sf_dir)
    return clean, windows.total_order(clean, "obs_id")


def q_lead_target(spark, sf_dir):
    clean, ties = _ordered_obs(spark, sf_dir)
    out = windows.add_target(clean, tiebreak=ties)
    return out.select("obs_id", "datetime", CITY, LABEL, TARGET)


def q_lag_features(spark, sf_dir):
    clean, ties = _ordered_obs(spark, sf_dir)
    out = windows.add_lags(clean, tiebreak=ties)
    return round_doubles(out.select("obs_id", "datetime", CITY, *NUMERIC_LAG_COLS, *LABEL_LAG_COLS))


def q_rolling_means(spark, sf_dir):
    clean, ties = _ordered_obs(spark, sf_dir)
    out = windows.add_rolling_means(clean, tiebreak=ties)
    return round_doubles(out.select("obs_id", "datetime", CITY, *WINDOW_COLS))


def q_calendar_features(spark, sf_dir):
    out = windows.add_calendar(fx.obs(spark, sf_dir))
    return round_doubles(out.select("obs_id", "datetime", *CALENDAR_COLS))


def forecast_frame(spark, sf_dir, **frame_opts) -> DataFrame:
    clean, ties = _ordered_obs(spark, sf_dir)
    return windows.forecast_features(clean, **{"tiebreak": ties, **frame_opts})


def q_forecast_features(spark, sf_dir):
    return round_doubles(forecast_frame(spark, sf_dir).select(*FORECAST_COLS))


EXACT_COLS = ["datetime", CITY, TARGET, *NUMERIC_LAG_COLS, *LABEL_LAG_COLS, *WINDOW_COLS]


def q_exact_time_features(spark, sf_dir):
    """Features by time on the hourly rows that have values, so there are gaps; blocks of four days."""
    merged = reshape.join_metrics(_wide_tables(spark, sf_dir))
    rows = merged.dropna(subset=["temperature"]).withColumn(LABEL, classify_description(LABEL))
    return round_doubles(windows.exact_time_features(rows, block_hours=96).select(*EXACT_COLS))


def q_label_counts(spark, sf_dir):
    return metrics.label_counts(cleaned_obs(spark, sf_dir))


def q_label_shares(spark, sf_dir):
    return round_doubles(metrics.label_shares(cleaned_obs(spark, sf_dir)))


def q_label_domain(spark, sf_dir):
    return metrics.label_domain(forecast_frame(spark, sf_dir), [TARGET, *LABEL_LAG_COLS])


def q_coverage(spark, sf_dir):
    return metrics.coverage(fx.obs(spark, sf_dir), CITY)


def q_day_slice(spark, sf_dir):
    day = cleaning.previous_day("2024-01-16")
    out = cleaning.day_slice(fx.obs(spark, sf_dir), day,
                             cols=["obs_id", "datetime", CITY, *METRICS, "weather_description"])
    return round_doubles(out)


# ---------------------------------------------------------------------------
# Sources, reshaping, joins
# ---------------------------------------------------------------------------

def _wide_dir(spark, sf_dir) -> str:
    return fx.write_wide_csvs(spark, sf_dir, fx.scratch(spark, "wide"))


def _wide_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return files.read_wide_metrics(spark, _wide_dir(spark, sf_dir))


def _stacked(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All six tables under one another: metric, keys, and a number and a text per value column
    (numbers for five of them, texts for the conditions)."""
    out = None
    for name, df in tables.items():
        values = [(c, "value" if c == name else c) for c in df.columns if c not in keys]
        text = name == LABEL
        one = df.select(F.lit(name).alias("metric"), *keys,
                        *[F.col(c).cast("double").alias(v) if not text else F.lit(None).cast("double").alias(v) for c, v in values],
                        *[F.col(c).alias(f"{v}_text") if text else F.lit(None).cast("string").alias(f"{v}_text") for c, v in values])
        out = one if out is None else out.unionByName(one)
    return out


def q_src_wide_csv(spark, sf_dir):
    return round_doubles(_stacked(_wide_tables(spark, sf_dir), ["datetime"]))


def q_wide_to_long(spark, sf_dir):
    wide = _wide_tables(spark, sf_dir)
    cities = reshape.common_columns(wide)
    return round_doubles(_stacked({n: reshape.wide_to_long(df, n, cities) for n, df in wide.items()}, ["datetime", CITY]))


def q_join_metrics(spark, sf_dir):
    return round_doubles(reshape.join_metrics(_wide_tables(spark, sf_dir)))


def q_join_places(spark, sf_dir):
    merged = reshape.join_metrics(_wide_tables(spark, sf_dir))
    return round_doubles(reshape.join_places(merged, fx.places(spark, sf_dir)))


def _order_span(spark, sf_dir):
    row = fx.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e")).first()
    return row["s"], row["e"]


def q_fetch_plan(spark, sf_dir):
    start, end = _order_span(spark, sf_dir)
    prov = fx.places(spark, sf_dir).select(F.col(CITY).alias("province_name"), F.col("Latitude").alias("latitude"),
                                           F.col("Longitude").alias("longitude"))
    return round_doubles(reshape.fetch_plan(prov, start, end))


def q_month_ranges(spark, sf_dir):
    req = (fx.table(spark, sf_dir, "orders").groupBy("o_custkey")
           .agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")))
    return reshape.explode_month_ranges(req, "start", "end").select("o_custkey", "range_start", "range_end")


def q_src_places_csv(spark, sf_dir):
    path = fx.write_places_csv(spark, sf_dir, fx.scratch(spark, "places_csv"))
    return round_doubles(files.read_places_csv(spark, path))


def q_src_places_json(spark, sf_dir):
    path = fx.write_provinces_json(spark, sf_dir, fx.scratch(spark, "provinces_json"))
    return round_doubles(files.read_places_json(spark, path))


def q_parse_history_json(spark, sf_dir):
    return round_doubles(payloads.parse_history(fx.history_payloads(spark, sf_dir)).select(*STORE_COLS))


def q_parse_current_json(spark, sf_dir):
    return round_doubles(payloads.parse_current(fx.current_payloads(spark, sf_dir), keep=("obs_id",)))


def q_parse_timestamps(spark, sf_dir):
    t = fx.timestamp_texts(spark, sf_dir)
    return t.select("obs_id", "raw", parse_timestamp("raw").alias("datetime")).where(F.col("datetime").isNotNull())


def q_numeric_coercion(spark, sf_dir):
    t = fx.numeric_texts(spark, sf_dir)
    return round_doubles(t.select("obs_id", to_double("raw").alias("humidity")))


def q_unit_conversions(spark, sf_dir):
    u = fx.raw_units(spark, sf_dir)
    return round_doubles(u.select("obs_id", celsius_to_kelvin("temp_c").alias("temperature"),
                                  kmph_to_mps("wind_kmph").alias("wind_speed")))


# ---------------------------------------------------------------------------
# Store: merge, upsert, counters, persisted upsert + scan
# ---------------------------------------------------------------------------

def q_merge_day_into_base(spark, sf_dir):
    """Create the history of all days, merge one day of the store into it, read it back."""
    path = fx.scratch(spark, "history")
    store.create_history(fx.store_rows(spark, sf_dir), path)
    store.merge_day_into_history(spark, path, fx.store_batch(spark, sf_dir), fx.MERGE_DAY, fx.scratch(spark, "merge_staging"))
    return round_doubles(files.read_store(spark, path))


def q_upsert_store(spark, sf_dir):
    out = store.upsert(fx.store_target(spark, sf_dir), fx.store_batch(spark, sf_dir))
    return round_doubles(out.select(*STORE_COLS))


def q_upsert_counts(spark, sf_dir):
    return store.upsert_counts(fx.store_target(spark, sf_dir), fx.store_batch(spark, sf_dir))


def q_store_scan(spark, sf_dir):
    """Write the keyed store (day partitions), upsert three overlapping batches through one
    staging root (the last repeats the second), scan the store back."""
    path, staging = fx.scratch(spark, "store"), fx.scratch(spark, "store_staging")
    files.write_store(fx.store_target(spark, sf_dir), path)
    for batch in (fx.store_batch, fx.store_correction, fx.store_correction):
        store.upsert_into_store(spark, path, batch(spark, sf_dir), staging)
    return round_doubles(files.read_store(spark, path))


def q_history_csv(spark, sf_dir):
    return round_doubles(files.read_history_csv(spark, fx.write_history_csv(spark, sf_dir, fx.scratch(spark, "history_csv"))))


# ---------------------------------------------------------------------------
# Sampling, encoding, scaling
# ---------------------------------------------------------------------------

def split_table(spark, sf_dir) -> DataFrame:
    return sampling.stratified_split(training_table(spark, sf_dir), LABEL, "obs_id")


def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("obs_id", LABEL, "split")


def q_undersample(spark, sf_dir):
    return sampling.undersample(training_table(spark, sf_dir), LABEL, "obs_id").select("obs_id", LABEL)


ENC_IN = [TARGET, *LABEL_LAG_COLS]
ENC_OUT = ["target_encoded_24h", *[f"{c}_encoded" for c in LABEL_LAG_COLS]]


def _encoded(spark, sf_dir):
    # The vocabulary is fitted on the labels of the feature frame (target ∪ label lags), then
    # applied to them: only those columns are written, and read twice.
    ff = materialise(forecast_frame(spark, sf_dir).select("obs_id", *ENC_IN), "label-columns")
    labels = encoding.fit_labels(ff, ENC_IN)
    return encoding.encode_labels(ff, labels, ENC_IN, ENC_OUT, "skip"), labels


def q_encode_labels(spark, sf_dir):
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("obs_id", *ENC_OUT)


def q_decode_labels(spark, sf_dir):
    enc, labels = _encoded(spark, sf_dir)
    dec = encoding.decode_labels(enc.select("obs_id", "target_encoded_24h"), labels, "target_encoded_24h",
                                 "target_decoded")
    return dec.select("obs_id", "target_decoded")


def q_scaler_stats(spark, sf_dir):
    train = split_table(spark, sf_dir).where(F.col("split") == "train")
    return round_doubles(encoding.scaler_stats(train, FEATURES))


def q_standard_scale(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    stats = encoding.fit_scaler(sp.where(F.col("split") == "train"), FEATURES)
    return round_doubles(encoding.standard_scale(sp, stats).select("obs_id", "split", *FEATURES))


# ---------------------------------------------------------------------------
# Classification metrics
# ---------------------------------------------------------------------------

def q_classification_report(spark, sf_dir):
    return round_doubles(metrics.classification_report(fx.predicted_class_obs(spark, sf_dir), "y", "yhat"))


def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(fx.predicted_class_obs(spark, sf_dir), "y", "yhat")


def q_confusion_matrix_norm(spark, sf_dir):
    return round_doubles(metrics.confusion_matrix(fx.predicted_class_obs(spark, sf_dir), "y", "yhat", normalize=True))


def q_classification_report_binary(spark, sf_dir):
    return round_doubles(metrics.classification_report(fx.labels_pairs(spark, sf_dir), "y", "yhat"))


def q_confusion_matrix_binary(spark, sf_dir):
    return metrics.confusion_matrix(fx.labels_pairs(spark, sf_dir), "y", "yhat")


def q_log_loss(spark, sf_dir):
    classes = sorted(CONDITION_CLASSES)
    return round_doubles(metrics.log_loss(fx.class_probabilities(spark, sf_dir, classes), "y", "p", classes))


# ---------------------------------------------------------------------------
# Training and scoring. Predictions have no SQL form; what is exact about them has: rows,
# supports, states, parameters, and that a saved model predicts as it did.
# ---------------------------------------------------------------------------

def _fitted(spark, sf_dir, algorithm="random_forest", rows=None, params=None):
    """(model, split table) with the default configuration, on ``rows`` (None: all training rows)."""
    tt = training_rows(spark, sf_dir) if rows is None else rows
    sp = materialise(sampling.stratified_split(tt, LABEL, "obs_id"), "split")
    train = sp.where(F.col("split") == "train")
    labels = encoding.fit_labels(sp, [LABEL])
    stats = encoding.fit_scaler(train, FEATURES)
    resolved, _ = modeling.resolve_params(params, algorithm=algorithm)
    return modeling.train_classifier(train, labels, stats, resolved, algorithm), sp


def _params_text(params) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted(params.items()))


def q_train_report(spark, sf_dir):
    """The report that training gives, held against SQL over the saved predictions of its test rows."""
    # training_table's label is already a class (classified in this plan)
    tt = training_rows(spark, sf_dir)
    model, report, _ = modeling.retrain(spark, tt, "obs_id", classify_label=False)
    split = sampling.stratified_split(modeling.prepare(tt, classify_label=False), LABEL, "obs_id")
    return _judged(spark, model, split.where("split = 'test'"), own=report)


def q_train_full(spark, sf_dir):
    """Full refit from the persisted history table of every event (store scan → retrain)."""
    path = fx.scratch(spark, "history")
    store.create_history(fx.store_rows(spark, sf_dir), path)
    hist = files.read_store(spark, path).withColumn("_key", F.concat_ws("|", F.col("datetime").cast("string"), "province"))
    _, _, done = modeling.retrain(spark, hist, "_key", {"lambda": 2, "bogus": 1}, defaults=modeling.FULL_REFIT_PARAMS)
    return spark.createDataFrame([(done["n_train"], done["n_test"], _params_text(done["params_used"]), ",".join(done["ignored_params"]))],
                                 "n_train long, n_test long, params_used string, ignored_params string")


def q_retrain_job(spark, sf_dir):
    """Two jobs on one artifact root: one that trains and activates, one without usable rows."""
    tt, root = training_rows(spark, sf_dir), fx.scratch(spark, "job_models")
    good, _ = modeling.retrain_job(spark, tt, "obs_id", root, classify_label=False)
    bad, _ = modeling.retrain_job(spark, tt.where("false"), "obs_id", root, classify_label=False)
    active = ",".join(modeling.model_labels(modeling.load_latest(root)))
    return good.unionByName(bad).select("status", "version", "n_train", "n_test", F.lit(active).alias("active_classes"))


def q_job_report(spark, sf_dir):
    """The report per class that a job has stored, held against SQL over the predictions of the model it
    has activated."""
    tt, root = training_rows(spark, sf_dir), fx.scratch(spark, "reported_models")
    modeling.retrain_job(spark, tt, "obs_id", root, overrides={"n_estimators": 20}, classify_label=False)
    model, version = modeling.load_active(root)
    split = sampling.stratified_split(modeling.prepare(tt, classify_label=False), LABEL, "obs_id")
    judged = _judged(spark, model, split.where("split = 'test'"), own=modeling.job_report(spark, root, version))
    status = modeling.job_results(spark, root).select("status", "version")
    return judged.withColumn("version", F.lit(version)).join(status, "version")


def q_score_batch(spark, sf_dir):
    _, _, model = _forest(spark, sf_dir)
    req = training_rows(spark, sf_dir).withColumn(
        "humidity", F.when(F.col("obs_id") % 29 == 0, F.lit(None).cast("double")).otherwise(F.col("humidity")))
    return modeling.score(model, req, keep=["obs_id"]).select(
        "obs_id", "status", F.col("prediction").isNotNull().alias("predicted"))


def q_score_fallback(spark, sf_dir):
    root, _, _ = _forest(spark, sf_dir)
    cur = payloads.current_as_features(payloads.parse_current(fx.current_payloads(spark, sf_dir), keep=("obs_id",)))
    out = modeling.classify_or_predict_latest(cur, root)
    own = F.when(F.col("condition_source") == SOURCE_API, F.col(LABEL))
    return out.select("obs_id", "condition_source", own.alias("api_condition"),
                      (F.col(LABEL) == UNKNOWN).alias("still_unknown"))


def q_train_incremental(spark, sf_dir):
    """MLP fitted on all days but the last and continued on that (warm start): classes and scaler
    stay, weights move."""
    day = F.to_date("datetime")
    tt = training_rows(spark, sf_dir)
    last = tt.agg(F.max(day).alias("d")).first()["d"]
    model, sp = _fitted(spark, sf_dir, "mlp", rows=tt.where(day < F.lit(last)))
    rows = materialise(tt.where(day == F.lit(last)), "last-day")
    updated = modeling.train_incremental(model, rows, classify_label=False)
    moved = bool((model.stages[2].weights.toArray() != updated.stages[2].weights.toArray()).any())
    return rows.agg(F.count(F.lit(1)).alias("n_day")).select(
        "n_day", F.lit(",".join(modeling.model_labels(updated))).alias("classes"),
        F.lit(modeling.scaler_of(updated) == modeling.scaler_of(model)).alias("scaler_kept"),
        F.lit(moved).alias("weights_moved"))


def q_model_roundtrip(spark, sf_dir):
    root, sp, model = _forest(spark, sf_dir)
    loaded = modeling.load_latest(root)
    test = sp.where(F.col("split") == "test").select("obs_id", *FEATURES)
    once = modeling.score(model, test).withColumnRenamed("prediction", "before").drop("status")
    both = modeling.score(loaded, once)
    return both.select("obs_id", F.col("prediction").eqNullSafe(F.col("before")).alias("same_prediction"))


# ---------------------------------------------------------------------------
# Boosting, and what models predict: saved predictions are judged once by the library's
# operators and once by plain SQL.
# ---------------------------------------------------------------------------

BOOST = {"n_estimators": 5, "max_depth": 5}  # `boost_report` trains with the defaults
STUMP_FEATURES = ["humidity", "wind_speed"]  # fewer values than bins: every split is tried
_trained: dict[tuple[str, str, str, str], tuple[str, DataFrame, object]] = {}


def _saved(spark, sf_dir, algorithm, params=None) -> tuple[str, DataFrame, object]:
    """(root of the saved model, split table, the model as it was fitted); trained once in a session."""
    known = (spark.sparkContext.applicationId, sf_dir, algorithm, _params_text(params or {}))
    if known not in _trained:
        model, split = _fitted(spark, sf_dir, algorithm, params=params)
        root = fx.scratch(spark, algorithm)
        modeling.save_model(model, root)
        _trained[known] = root, split, model
    return _trained[known]


def _forest(spark, sf_dir) -> tuple[str, DataFrame, object]:
    return _saved(spark, sf_dir, "random_forest")


def _boosted(spark, sf_dir, params=None) -> tuple[str, DataFrame]:
    return _saved(spark, sf_dir, "softmax_boost", params)[:2]


REPORT_SQL = """
WITH l AS (SELECT explode(array(y, yhat)) AS label FROM {pairs}),
c AS (SELECT d.label, (SELECT count(*) FROM {pairs} p WHERE p.y = d.label) AS support,
        (SELECT count(*) FROM {pairs} p WHERE p.yhat = d.label) AS told,
        (SELECT count(*) FROM {pairs} p WHERE p.y = d.label AND p.yhat = d.label) AS hit FROM (SELECT DISTINCT label FROM l) d),
r AS (SELECT label, support, coalesce(try_divide(hit, told), 0) AS precision, coalesce(try_divide(hit, support), 0) AS recall,
        coalesce(try_divide(2 * hit, told + support), 0) AS f1 FROM c),
a AS (SELECT avg(CASE WHEN y = yhat THEN 1.0D ELSE 0.0D END) AS accuracy FROM {pairs}),
m AS (SELECT max(support) / sum(support) AS majority FROM r)
SELECT r.*, a.accuracy, m.majority FROM r, a, m
UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1), max(accuracy), max(majority) FROM r, a, m
UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), max(accuracy), max(majority) FROM r, a, m"""


def _judged(spark, model, test, label=LABEL, own=None):
    """Report of ``model`` on ``test`` (``own``, if it is at hand): label, support, whether SQL over the saved predictions gives the same
    figures, and whether the accuracy beats the share of the largest class."""
    pairs = materialise(modeling.score(model, test, keep=[label]).where("status = 'ok'")
                        .select(F.col(label).alias("y"), F.col("prediction").alias("yhat")), "predictions")
    own = metrics.classification_report(pairs, "y", "yhat") if own is None else own
    sql = spark.sql(REPORT_SQL, pairs=pairs)
    figures = ["precision", "recall", "f1", "accuracy", "support"]
    same = F.lit(True)
    for c in figures:
        same = same & (F.abs(own[c] - sql[c]) < 1e-9)
    return own.join(sql, "label", "full").select("label", own["support"], F.coalesce(same, F.lit(False)).alias("same_by_sql"),
                                                 (own["accuracy"] > sql["majority"]).alias("beats_majority"))


def q_boost_first_round(spark, sf_dir):
    """The trees of the first round, one split deep, on all rows: their splits and leaf values are exact."""
    tt = training_table(spark, sf_dir)
    labels = encoding.fit_labels(tt, [LABEL])
    params, _ = modeling.resolve_params({"n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0,
                                         "reg_lambda": 2, "reg_alpha": 0.5}, algorithm="softmax_boost")
    model = boosting.fit(tt, labels, {}, params, STUMP_FEATURES)
    rows = [(c, STUMP_FEATURES[int(t.feature[0])], float(t.threshold[0]), float(t.value[t.left[0]]), float(t.value[t.right[0]]))
            for c, t in zip(labels, model.rounds[0])]
    return round_doubles(spark.createDataFrame(rows, "label string, feature string, threshold double, value_left double, value_right double"))


def q_boost_report(spark, sf_dir):
    root, split = _boosted(spark, sf_dir)
    return _judged(spark, modeling.load_latest(root), split.where("split = 'test'"))


def q_boost_losses(spark, sf_dir):
    """Log-loss on the test rows after each round, in one pass, beside that of each prefix scored alone."""
    root, split = _boosted(spark, sf_dir, BOOST)
    model, test = modeling.load_latest(root), split.where("split = 'test'")
    staged = boosting.staged_log_loss(model, test)
    alone = None
    for r in range(1, len(model.rounds) + 1):
        prefix = boosting.BoostedModel(model.labels, model.features, model.scaler_stats, model.rounds[:r])
        one = modeling.evaluate_log_loss(prefix, test).select(F.lit(r).alias("round"), F.col("log_loss").alias("alone"))
        alone = one if alone is None else alone.unionByName(one)
    falls = F.col("log_loss") < F.coalesce(F.lag("log_loss").over(Window.orderBy("round")), F.lit(math.log(len(model.labels))))
    return staged.join(alone, "round").select("round", "n", (F.abs(F.col("log_loss") - F.col("alone")) < 1e-9).alias("same_alone"),
                                              falls.alias("falls"))


def q_boost_update(spark, sf_dir):
    """The day's update from the store: a model of the history but for its last day is continued on
    that, and on a day that is not there."""
    path, root = fx.scratch(spark, "history"), fx.scratch(spark, "update_models")
    store.create_history(fx.store_rows(spark, sf_dir), path)
    history = files.read_store(spark, path)
    day = history.agg(F.to_date(F.max("datetime")).alias("d")).first()["d"]
    past = modeling.prepare(history.where(F.to_date("datetime") < F.lit(day)))
    labels, stats = encoding.fit_labels(past, [LABEL]), encoding.fit_scaler(past, FEATURES)
    params, _ = modeling.resolve_params({**BOOST, "n_estimators": 3}, algorithm="softmax_boost")
    modeling.save_model(modeling.train_classifier(past, labels, stats, params, "softmax_boost"), root)
    before = modeling.load_latest(root)
    done = modeling.update_from_store(spark, path, day, root, {**BOOST, "n_estimators": 2})
    none = modeling.update_from_store(spark, path, day + datetime.timedelta(days=366), root, BOOST)
    after = modeling.load_latest(root)
    kept = all((a == b).all() for old, new in zip(before.rounds, after.rounds) for s, t in zip(old, new) for a, b in zip(s, t))
    rows = modeling.prepare(store.day_of_store(spark, path, day))
    earlier, later = (boosting.staged_log_loss(m, rows).orderBy(F.desc("round")).first()["log_loss"] for m in (before, after))
    return done.unionByName(none).select("status", "n_rows", "from_version", "version", F.lit(len(before.rounds)).alias("rounds_before"),
                                         F.lit(len(after.rounds)).alias("rounds_after"), F.lit(bool(kept)).alias("trees_kept"),
                                         F.lit(bool(later < earlier)).alias("fits_the_day_better"))


def q_forest_report(spark, sf_dir):
    model, split = _fitted(spark, sf_dir, params={"n_estimators": 50})
    return _judged(spark, model, split.where("split = 'test'"))


def q_log_loss_ovr(spark, sf_dir):
    """Log-loss of a one-vs-rest model, held against SQL over its saved probabilities."""
    model, split = _fitted(spark, sf_dir, "gbt_ovr", params={"n_estimators": 3, "max_depth": 4})
    test = split.where("split = 'test'")
    saved = materialise(modeling.class_probabilities(model, test).select(F.col(LABEL).alias("y"), F.col("probability").alias("p")), "probabilities")
    places = ", ".join(f"'{c}'" for c in modeling.model_labels(model))
    sql = spark.sql(f"SELECT avg(-ln(p[array_position(array({places}), y) - 1])) AS by_sql, "
                    "min(abs(aggregate(p, 0D, (a, x) -> a + x) - 1) < 1e-9) AS sums_to_one FROM {saved}", saved=saved)
    loss = modeling.evaluate_log_loss(model, test)
    return loss.crossJoin(sql).select("n", (F.abs(F.col("log_loss") - F.col("by_sql")) < 1e-9).alias("same_by_sql"), "sums_to_one",
                                      (F.col("log_loss") < math.log(len(modeling.model_labels(model)))).alias("beats_chance"))


def q_train_wide(spark, sf_dir):
    """The historical classifier: wide tables joined, coordinates, classes, split, boosting, and the
    normalised confusion matrix of the test rows (a row per true class)."""
    merged = reshape.join_places(reshape.join_metrics(_wide_tables(spark, sf_dir)), fx.places(spark, sf_dir))
    named = merged.withColumnsRenamed({"Latitude": "latitude", "Longitude": "longitude"}).withColumn(
        "_key", F.concat_ws("|", F.col("datetime").cast("string"), CITY))
    split = materialise(sampling.stratified_split(modeling.prepare(named), LABEL, "_key"), "wide-split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    labels, stats = encoding.fit_labels(split, [LABEL]), encoding.fit_scaler(train, FEATURES)
    params, _ = modeling.resolve_params(BOOST, algorithm="softmax_boost")
    model = modeling.train_classifier(train, labels, stats, params, "softmax_boost")
    pairs = materialise(modeling.score(model, test, keep=[LABEL]), "wide-predictions")
    matrix = metrics.confusion_matrix(pairs, LABEL, "prediction", classes=labels, normalize=True)
    support = pairs.groupBy(F.col(LABEL).alias("y")).agg(F.count(F.lit(1)).alias("support"))
    hit = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("rate")).otherwise(0.0))
    rows = matrix.groupBy("y").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("rate").alias("rates"), hit.alias("hit")).join(support, "y")
    accuracy = F.sum(F.col("hit") * F.col("support")).over(Window.partitionBy()) / F.sum("support").over(Window.partitionBy())
    majority = F.max("support").over(Window.partitionBy()) / F.sum("support").over(Window.partitionBy())
    return round_doubles(rows.select("y", "n_classes", "rates", "support", (accuracy > majority).alias("beats_majority")))


# ---------------------------------------------------------------------------
# The T+24h forecaster
# ---------------------------------------------------------------------------

def _forecast_rows(spark, sf_dir):
    observations = reshape.join_places(cleaned_rows(spark, sf_dir), fx.places(spark, sf_dir))
    rows, labels = forecast.forecast_rows(observations)
    return materialise(rows, "forecast-split"), labels


def q_forecast_matrix(spark, sf_dir):
    rows, _ = _forecast_rows(spark, sf_dir)
    matrix, _ = forecast.forecast_matrix(rows)
    return round_doubles(matrix.select("obs_id", "split", TARGET_ENCODED, *FORECAST_FEATURES))


def q_forecast_balance(spark, sf_dir):
    rows, _ = _forecast_rows(spark, sf_dir)
    return forecast.balanced_train(rows).groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"))


def q_train_forecast(spark, sf_dir):
    rows, labels = _forecast_rows(spark, sf_dir)
    model, report = forecast.train_forecast(rows, labels)
    return _judged(spark, model, rows.where("split = 'test'"), TARGET, report).drop("beats_majority")


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------

def q_ingest_stream(spark, sf_dir):
    """Landing payload files → readStream → parse → foreachBatch upsert → store scan, then the
    same again with a new checkpoint and the same staging root (a full replay)."""
    landing = fx.write_landing(spark, sf_dir, fx.scratch(spark, "landing"))
    store_path, staging = fx.scratch(spark, "stream_store"), fx.scratch(spark, "stream_staging")
    for _ in range(2):
        q = ingest.ingest_stream(spark, landing, store_path, fx.scratch(spark, "stream_ckpt"), staging,
                                 max_files_per_trigger=2)
        q.awaitTermination()
    return round_doubles(files.read_store(spark, store_path))


def q_ingest_ledger(spark, sf_dir):
    """Totals of the ledger after an ingest in which every payload comes once whole and once cut off,
    and after a full replay from a new checkpoint: what had been stored is stored."""
    landing = fx.write_landing(spark, sf_dir, fx.scratch(spark, "landing"), broken=True)
    path = fx.scratch(spark, "ledger_store")
    checkpoints = [fx.scratch(spark, "ledger_ckpt") for _ in range(2)]
    for checkpoint in (checkpoints[0], checkpoints[0], checkpoints[1]):  # the second run finds nothing new
        ingest.ingest_stream(spark, landing, path, checkpoint, max_files_per_trigger=2).awaitTermination()
    run = F.when(F.col("writer") == checkpoints[0], 1).otherwise(2)
    return snapshots.ledger(spark, path).groupBy(run.alias("run")).agg(
        *[F.sum(c).alias(c) for c in ("records", "malformed", "inserted", "skipped")],
        F.min(F.col("saved") == F.col("inserted") + F.col("modified")).alias("adds_up"))


def q_store_day_slice(spark, sf_dir):
    """One day of the persisted store after an upsert: only that day's partition is read."""
    path = fx.scratch(spark, "slice_store")
    files.write_store(fx.store_target(spark, sf_dir), path)
    store.upsert_into_store(spark, path, fx.store_batch(spark, sf_dir))
    return round_doubles(store.day_of_store(spark, path, fx.MERGE_DAY))


def q_score_stream(spark, sf_dir):
    """Requests that land in two lots, scored as a stream that is started again from its checkpoint
    after the second; every row is held against batch scoring."""
    root, _ = _boosted(spark, sf_dir, BOOST)
    requests, out, checkpoint = (fx.scratch(spark, n) for n in ("requests", "scored", "score_ckpt"))
    rows = training_rows(spark, sf_dir).withColumn(
        "humidity", F.when(F.col("obs_id") % 29 == 0, F.lit(None).cast("double")).otherwise(F.col("humidity")))
    for lot in range(2):
        rows.where(F.col("obs_id") % 2 == lot).write.mode("append").parquet(requests)
        scoring.score_stream(spark, requests, rows.schema, root, out, checkpoint, ["obs_id"]).awaitTermination()
    model, version = modeling.load_active(root)
    batch = modeling.score(model, rows, keep=["obs_id"]).select("obs_id", F.col("prediction").alias("alone"))
    return scoring.read_scored(spark, out).join(batch, "obs_id").select(
        "obs_id", "status", F.col("prediction").eqNullSafe(F.col("alone")).alias("same_as_batch"),
        (F.col("model_version") == version).alias("version_told"))


def queries() -> dict[str, Query]:
    return {
        "classify_description": q_classify_description,
        "clean_observations": q_clean_observations,
        "cleaning_audit": q_cleaning_audit,
        "select_features": q_select_features,
        "lead_target": q_lead_target,
        "lag_features": q_lag_features,
        "rolling_means": q_rolling_means,
        "calendar_features": q_calendar_features,
        "forecast_features": q_forecast_features,
        "exact_time_features": q_exact_time_features,
        "label_counts": q_label_counts,
        "label_shares": q_label_shares,
        "label_domain": q_label_domain,
        "coverage": q_coverage,
        "day_slice": q_day_slice,
        "src_wide_csv": q_src_wide_csv,
        "wide_to_long": q_wide_to_long,
        "join_metrics": q_join_metrics,
        "join_places": q_join_places,
        "fetch_plan": q_fetch_plan,
        "month_ranges": q_month_ranges,
        "src_places_csv": q_src_places_csv,
        "src_places_json": q_src_places_json,
        "parse_history_json": q_parse_history_json,
        "parse_current_json": q_parse_current_json,
        "parse_timestamps": q_parse_timestamps,
        "numeric_coercion": q_numeric_coercion,
        "unit_conversions": q_unit_conversions,
        "merge_day_into_base": q_merge_day_into_base,
        "upsert_store": q_upsert_store,
        "upsert_counts": q_upsert_counts,
        "store_scan": q_store_scan,
        "history_csv": q_history_csv,
        "stratified_split": q_stratified_split,
        "undersample": q_undersample,
        "encode_labels": q_encode_labels,
        "decode_labels": q_decode_labels,
        "scaler_stats": q_scaler_stats,
        "standard_scale": q_standard_scale,
        "classification_report": q_classification_report,
        "confusion_matrix": q_confusion_matrix,
        "confusion_matrix_norm": q_confusion_matrix_norm,
        "classification_report_binary": q_classification_report_binary,
        "confusion_matrix_binary": q_confusion_matrix_binary,
        "log_loss": q_log_loss,
        "forecast_matrix": q_forecast_matrix,
        "forecast_balance": q_forecast_balance,
        "train_forecast": q_train_forecast,
        "retrain_job": q_retrain_job,
        "job_report": q_job_report,
        "train_report": q_train_report,
        "train_full": q_train_full,
        "score_batch": q_score_batch,
        "score_fallback": q_score_fallback,
        "train_incremental": q_train_incremental,
        "model_roundtrip": q_model_roundtrip,
        "ingest_stream": q_ingest_stream,
        "boost_first_round": q_boost_first_round,
        "boost_report": q_boost_report,
        "boost_losses": q_boost_losses,
        "boost_update": q_boost_update,
        "forest_report": q_forest_report,
        "log_loss_ovr": q_log_loss_ovr,
        "train_wide": q_train_wide,
        "ingest_ledger": q_ingest_ledger,
        "store_day_slice": q_store_day_slice,
        "score_stream": q_score_stream,
    }
