"""The T+24h forecaster: 72-column feature matrix, split, scaling, balanced training."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..config import (CITY, DATETIME, FORECAST_FEATURES, LABEL, LABEL_LAG_COLS, SEED, TARGET, TARGET_ENCODED,
                      TEST_FRACTION)
from ..session import materialise
from . import encoding, modeling, sampling, windows

ENCODED_COLS = [TARGET_ENCODED, *[f"{c}_encoded" for c in LABEL_LAG_COLS]]


def forecast_rows(observations: DataFrame, key: str = "obs_id", place: str = CITY, time_col: str = DATETIME,
                  label: str = LABEL, test_fraction: float = TEST_FRACTION, seed: int = SEED,
                  **frame_opts) -> tuple[DataFrame, list[str]]:
    """(rows, labels): one unscaled row per usable observation with ``split``, the target class
    and its code, and the 72 features in order.

    ``observations`` are cleaned and have Latitude and Longitude. One vocabulary covers the
    target and its lags; the split is stratified by target. The rows are written once, as the
    vocabulary, the scaler and the training all read them. Rows of a place that share their time
    are ordered by the key.
    """
    frame_opts = {"tiebreak": windows.total_order(observations, key, place, time_col), **frame_opts}
    framed = materialise(windows.forecast_features(observations, place, time_col, label, **frame_opts), "forecast-rows")
    labels = encoding.fit_labels(framed, [TARGET, *LABEL_LAG_COLS])
    coded = encoding.encode_labels(framed, labels, [TARGET, *LABEL_LAG_COLS], ENCODED_COLS, "skip")
    # written once more: the passes of the split would each encode all columns again
    ready = materialise(coded.dropna(subset=[*FORECAST_FEATURES, TARGET_ENCODED]).select(
        key, TARGET, TARGET_ENCODED, *[F.col(c).cast("double").alias(c) for c in FORECAST_FEATURES]), "forecast-coded")
    rows = sampling.stratified_split(ready, TARGET, key, test_fraction, seed)
    return rows.select(key, "split", TARGET, TARGET_ENCODED, *FORECAST_FEATURES), labels


def forecast_matrix(rows: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(matrix, statistics): the features scaled with mean and deviation of the train rows."""
    stats = encoding.fit_scaler(rows.where(F.col("split") == "train"), FORECAST_FEATURES)
    return encoding.standard_scale(rows, stats), stats


def balanced_train(rows: DataFrame, key: str = "obs_id", seed: int = SEED) -> DataFrame:
    """Train rows with every target class reduced to the smallest; test rows are never touched."""
    return sampling.undersample(rows.where(F.col("split") == "train"), TARGET, key, seed)


def train_forecast(rows: DataFrame, labels: list[str], overrides: Mapping[str, object] | None = None,
                   algorithm: str = "random_forest", key: str = "obs_id", seed: int = SEED):
    """Fit on the scaled, balanced train rows; returns (model, report on all test rows)."""
    params, _ = modeling.resolve_params(overrides, modeling.FORECAST_PARAMS, algorithm)
    _, stats = forecast_matrix(rows)  # the model scales with the statistics of all train rows
    model = modeling.train_classifier(balanced_train(rows, key, seed), labels, stats, params, algorithm,
                                      FORECAST_FEATURES, TARGET)
    return model, modeling.evaluate(model, rows.where(F.col("split") == "test"), TARGET)
