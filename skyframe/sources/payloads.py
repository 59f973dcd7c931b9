"""Nested JSON payloads → observation rows (``from_json`` + ``explode``, no UDF).

A malformed document, a missing ``data``/``weather`` or an empty list yields no
rows; a bad numeric field becomes NULL instead of discarding its payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CURRENT_PAYLOAD_SCHEMA, HISTORY_PAYLOAD_SCHEMA, LABEL, UNKNOWN
from ..functions.conditions import classify_description
from ..functions.scalars import celsius_to_kelvin, hour_from_hhmm, hour_text, kmph_to_mps, parse_timestamp, to_double


def _first_desc(arr: Column) -> Column:
    return F.get(arr, 0).getField("value")


def parse_history(df: DataFrame, payload: str = "payload", province: str = "province",
                  latitude: str = "latitude", longitude: str = "longitude",
                  order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """Historical payload → one row per (day, hour) entry, store columns.

    Hours without ``time`` are skipped; ``time`` "0".."2300" gives the hour; °C → K,
    km/h → m/s (2 decimals); the first description (default "Unknown") is classified.
    With ``order_cols`` a ``seq`` struct (order columns, day position, hour position)
    is added so that later entries can win a keyed merge.
    """
    doc = F.from_json(F.col(payload), HISTORY_PAYLOAD_SCHEMA)
    order = list(order_cols or ())
    days = df.select(F.col(province).alias("province"), F.col(latitude).alias("latitude"),
                     F.col(longitude).alias("longitude"), *order,
                     F.posexplode(doc.getField("data").getField("weather")).alias("_dp", "d"))
    hours = days.select("province", "latitude", "longitude", *order, "_dp", F.col("d.date").alias("_date"),
                        F.posexplode("d.hourly").alias("_hp", "h"))
    hour = hour_from_hhmm(F.col("h.time"))
    # try_cast to timestamp_ntz: naive wall-clock time, no session time zone involved
    stamp = parse_timestamp(F.concat(F.col("_date"), F.lit(" "), hour_text("h.time"), F.lit(":00:00")))
    stamp = F.when((hour >= 0) & (hour <= 23), stamp)
    desc = F.coalesce(_first_desc(F.col("h.weatherDesc")), F.lit("Unknown"))
    rows = hours.where(F.col("h.time").isNotNull()).select(
        stamp.alias("datetime"),
        "province",
        to_double("h.humidity").alias("humidity"),
        "latitude", "longitude",
        to_double("h.pressure").alias("pressure"),
        celsius_to_kelvin(to_double("h.tempC")).alias("temperature"),
        classify_description(desc).alias(LABEL),
        to_double("h.winddirDegree").alias("wind_direction"),
        kmph_to_mps("h.windspeedKmph").alias("wind_speed"),
        *([F.struct(*order, "_dp", "_hp").alias("seq")] if order_cols is not None else []),
    )
    return rows.where(F.col("datetime").isNotNull())


def is_malformed(payload: str | Column) -> Column:
    """Whether a historical payload holds no list of days: no JSON, or not the expected document."""
    column = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(column, HISTORY_PAYLOAD_SCHEMA).getField("data").getField("weather").isNull()


CURRENT_COLS = ["latitude", "longitude", "observed_time_utc", "temperature_celsius", "temperature_kelvin",
                "humidity", "pressure", "wind_speed_mps", "wind_direction_degree", LABEL]


def parse_current(df: DataFrame, payload: str = "payload", latitude: str = "latitude",
                  longitude: str = "longitude", keep: tuple[str, ...] = ()) -> DataFrame:
    """Current-conditions payload → one row (none when ``current_condition`` is absent
    or empty). NULL or empty description → ``unknown``."""
    doc = F.from_json(F.col(payload), CURRENT_PAYLOAD_SCHEMA)
    cur = F.get(doc.getField("data").getField("current_condition"), 0)
    base = df.select(*keep, F.col(latitude).alias("latitude"), F.col(longitude).alias("longitude"),
                     cur.alias("c")).where(F.col("c").isNotNull())
    temp_c = to_double("c.temp_C")
    desc = _first_desc(F.col("c.weatherDesc"))
    cond = F.when(desc.isNull() | (desc == F.lit("")), F.lit(UNKNOWN)).otherwise(classify_description(desc))
    return base.select(
        *keep, "latitude", "longitude",
        F.col("c.observation_time").alias("observed_time_utc"),
        temp_c.alias("temperature_celsius"),
        celsius_to_kelvin(temp_c).alias("temperature_kelvin"),
        to_double("c.humidity").alias("humidity"),
        to_double("c.pressure").alias("pressure"),
        kmph_to_mps("c.windspeedKmph").alias("wind_speed_mps"),
        to_double("c.winddirDegree").alias("wind_direction_degree"),
        cond.alias(LABEL),
    )


def current_as_features(df: DataFrame) -> DataFrame:
    """Rename a parsed current row to the model's feature names (K and m/s)."""
    return (df.withColumnRenamed("temperature_kelvin", "temperature")
              .withColumnRenamed("wind_speed_mps", "wind_speed")
              .withColumnRenamed("wind_direction_degree", "wind_direction"))
