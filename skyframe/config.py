"""Column names, feature lists and schemas shared by every job.

Everything here is configuration of the jobs; nothing executes.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
DATETIME = "datetime"
CITY = "City"
PROVINCE = "province"
LABEL = "weather_condition"
UNKNOWN = "unknown"

# Base metrics, in this order.
METRICS = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed"]
# Model features of the observation store / scoring requests, in this order.
FEATURES = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed", "latitude", "longitude"]
# Location columns of the wide-CSV flow.
LOCATION_COLS = ["Latitude", "Longitude"]
# The ten columns of the observation store, in this order.
STORE_COLS = ["datetime", "province", "humidity", "latitude", "longitude", "pressure",
              "temperature", "weather_condition", "wind_direction", "wind_speed"]
STORE_KEYS = ["datetime", "province"]

FORECAST_HORIZON = 24
LAG_STEPS = [1, 3, 6, 12, 24, 48]
WINDOW_SIZES = [6, 12, 24, 48]
CALENDAR_COLS = ["hour", "dayofweek", "dayofyear", "month", "year",
                 "hour_sin", "hour_cos", "dayofyear_sin", "dayofyear_cos"]

# Wide metric tables, one CSV each, by value column.
WIDE_TABLES = ["humidity", "pressure", "temperature", "weather_condition", "wind_direction", "wind_speed"]

# Files of the wide tables: named like the value, but for the descriptions.
WIDE_FILES = {**{name: name for name in WIDE_TABLES}, "weather_condition": "weather_description"}

KELVIN_OFFSET = 273.15
KMPH_TO_MPS = 10 / 36
TEST_FRACTION = 0.2
SEED = 42

# Condition source tags of the classify-else-predict step.
SOURCE_API = "api"
SOURCE_PREDICTED = "predicted (fallback)"
SOURCE_MISSING = "api (prediction fallback failed - missing features)"
SOURCE_PRED_ERROR = "api (prediction fallback failed - prediction error)"
SOURCE_EXCEPTION = "api (prediction fallback failed - exception)"

# ---------------------------------------------------------------------------
# Derived names
# ---------------------------------------------------------------------------
TARGET = f"target_{LABEL}_{FORECAST_HORIZON}h"
TARGET_ENCODED = f"target_encoded_{FORECAST_HORIZON}h"


def lag_name(col: str, k: int) -> str:
    return f"{col}_lag_{k}h"


def window_name(col: str, w: int) -> str:
    return f"{col}_win_{w}h_mean"


NUMERIC_LAG_COLS = [lag_name(c, k) for c in METRICS for k in LAG_STEPS]
LABEL_LAG_COLS = [lag_name(LABEL, k) for k in LAG_STEPS]
ENCODED_LABEL_LAG_COLS = [f"{c}_encoded" for c in LABEL_LAG_COLS]
WINDOW_COLS = [window_name(c, w) for c in METRICS for w in WINDOW_SIZES]

# Forecast model vector: 5 base + 2 location + 30 lags + 6 encoded label lags + 20 means + 9 calendar = 72.
FORECAST_FEATURES = (METRICS + LOCATION_COLS + NUMERIC_LAG_COLS + ENCODED_LABEL_LAG_COLS
                     + WINDOW_COLS + CALENDAR_COLS)

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
STORE_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("province", T.StringType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("weather_condition", T.StringType()),
    T.StructField("wind_direction", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
])

PROVINCES_JSON_SCHEMA = T.StructType([
    T.StructField("province_name", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
])

_DESC = T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))

HISTORY_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("weather", T.ArrayType(T.StructType([
            T.StructField("date", T.StringType()),
            T.StructField("hourly", T.ArrayType(T.StructType([
                T.StructField("time", T.StringType()),
                T.StructField("humidity", T.StringType()),
                T.StructField("pressure", T.StringType()),
                T.StructField("tempC", T.StringType()),
                T.StructField("winddirDegree", T.StringType()),
                T.StructField("windspeedKmph", T.StringType()),
                T.StructField("weatherDesc", _DESC),
            ]))),
        ]))),
    ])),
])

CURRENT_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("current_condition", T.ArrayType(T.StructType([
            T.StructField("temp_C", T.StringType()),
            T.StructField("humidity", T.StringType()),
            T.StructField("pressure", T.StringType()),
            T.StructField("windspeedKmph", T.StringType()),
            T.StructField("winddirDegree", T.StringType()),
            T.StructField("observation_time", T.StringType()),
            T.StructField("weatherDesc", _DESC),
        ]))),
    ])),
])
