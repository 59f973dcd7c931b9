"""Stand-in inputs derived from the provided test tables.

These functions only reshape the given tables into the schemas the jobs expect
(observations, places, wide CSVs, payloads, store batches). They do none of the
jobs' work; every job takes their output as ordinary data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CITY, WIDE_FILES
from ..functions.conditions import classify_description
from ..functions.scalars import truncate_hour
from ..session import materialise, scratch_path, spread

# Fixed values of the fixture mapping (FIXTURES.md §2).
STATION_PREFIX = "station_"
N_STATIONS = 10
DESCRIPTIONS = [
    "Light rain", "Thunderstorm with heavy rain", "Light snow", "Partly Cloudy", "Mist", "Clear",
    "sky is clear", "overcast clouds", "Light rain and snow", "Thundery outbreaks possible", "Blizzard",
]  # event_id % 12 = 0..10; 11 → NULL

BASE_DAYS = (1, 20)      # store base: days 1-20
BATCH_DAYS = (15, 31)    # incoming batch: day 15 to the end of the table
CORRECTION_DAYS = (12, 22)  # a second batch, overlapping both
MERGE_DAY = "2024-01-18"
PAYLOAD_IDS = 200        # a payload holds the entries of at most so many consecutive ids
MAX_STATIONS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def description_for(event_id: Column) -> Column:
    m = event_id % 12
    expr = None
    for i, text in enumerate(DESCRIPTIONS):
        expr = F.when(m == i, F.lit(text)) if expr is None else expr.when(m == i, F.lit(text))
    return expr.otherwise(F.lit(None).cast("string"))


def _obs_columns() -> list[Column]:
    eid = F.col("event_id")
    return [
        eid.alias("obs_id"),
        F.col("ts").alias("datetime"),
        F.concat(F.lit(STATION_PREFIX), (F.col("user_id") % N_STATIONS).cast("string")).alias(CITY),
        ((eid * 7) % 101).cast("double").alias("humidity"),
        (F.lit(980) + (eid * 13) % 60).cast("double").alias("pressure"),
        (F.lit(273.15) + F.col("value") / 10).alias("temperature"),
        ((eid * 37) % 360).cast("double").alias("wind_direction"),
        ((eid * 11) % 25).cast("double").alias("wind_speed"),
        description_for(eid).alias("weather_description"),
    ]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as hourly station observations (the ``obs`` view)."""
    return table(spark, sf_dir, "events").select(*_obs_columns())


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``events`` that observations are made of, dealt evenly to files: a filter
    would be moved below a mere repartition, into the tasks of the few files that were."""
    return materialise(spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")), "events")


def spread_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs``, dealt evenly to tasks: for what works long on each row."""
    return spread_events(spark, sf_dir).select(*_obs_columns())


def obs_celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` with the measured temperature in °C."""
    return table(spark, sf_dir, "events").select(*_obs_columns(), (F.col("value") / 10).alias("temp_c"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` read as a place dimension: City, Country, Latitude, Longitude."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit(STATION_PREFIX), F.col("n_nationkey").cast("string")).alias(CITY),
        F.col("n_name").alias("Country"),
        (F.col("n_nationkey") * 1.5).cast("double").alias("Latitude"),
        (F.lit(100.0) + F.col("n_nationkey") * 0.5).cast("double").alias("Longitude"),
    )


def predicted_class_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, y, yhat): truth = class of the row, prediction = class of obs_id + 1."""
    o = obs(spark, sf_dir)
    return o.select("obs_id", classify_description("weather_description").alias("y"),
                    classify_description(description_for(F.col("obs_id") + 1)).alias("yhat"))


def labels_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as (doc_id, y = quality, yhat = toxic), as strings."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").cast("string").alias("y"),
                      F.col("toxic").cast("string").alias("yhat"))


# ---------------------------------------------------------------------------
# Store fixtures: key (hour, province), sequence = event_id
# ---------------------------------------------------------------------------

def store_rows(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """Store-schema rows from ``events`` plus a ``seq`` column (= event_id)."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    value = F.col("value")
    if changed:
        value = F.when(eid % 3 == 0, value + 1).otherwise(value)
    return ev.select(
        truncate_hour("ts").alias("datetime"),
        F.concat(F.lit("province_"), F.col("user_id").cast("string")).alias("province"),
        ((eid * 7) % 101).cast("double").alias("humidity"),
        (F.col("user_id") % 90).cast("double").alias("latitude"),
        (F.lit(100) + F.col("user_id") % 10).cast("double").alias("longitude"),
        (F.lit(980) + (eid * 13) % 60).cast("double").alias("pressure"),
        (F.lit(273.15) + value / 10).alias("temperature"),
        classify_description(description_for(eid)).alias("weather_condition"),
        ((eid * 37) % 360).cast("double").alias("wind_direction"),
        ((eid * 11) % 25).cast("double").alias("wind_speed"),
        eid.alias("seq"),
    )


def store_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch, days 12-22, every 5th id: temperature up by one degree, every 31st
    humidity not a number, every 89th no province."""
    b = store_rows(spark, sf_dir).where(_day_between(CORRECTION_DAYS) & (F.col("seq") % 5 == 0))
    return (b.withColumn("temperature", F.col("temperature") + 1)
            .withColumn("humidity", F.when(F.col("seq") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("humidity")))
            .withColumn("province", F.when(F.col("seq") % 89 != 0, F.col("province"))))


def _day_between(days: tuple[int, int]) -> Column:
    d = F.dayofmonth("datetime")
    return (d >= days[0]) & (d <= days[1])


def store_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of days 1-20 (may repeat a key; later ``seq`` is newer)."""
    return store_rows(spark, sf_dir).where(_day_between(BASE_DAYS))


def store_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows from day 15 on with changed temperatures; every 97th has no province."""
    b = store_rows(spark, sf_dir, changed=True).where(_day_between(BATCH_DAYS))
    return b.withColumn("province", F.when(F.col("seq") % 97 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("province")))


def store_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed store (unique key): per key of days 1-20, the row with the largest event_id."""
    base = store_base(spark, sf_dir)
    cols = [c for c in base.columns if c not in ("datetime", "province")]
    latest = base.groupBy("datetime", "province").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("r"))
    return latest.select("datetime", "province", *[F.col(f"r.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------------------
# Files written for the scan / stream queries
# ---------------------------------------------------------------------------

def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def hourly_station_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` per (hour, City): mean of each metric; description = class of the highest obs_id."""
    o = fx_obs_hourly(spark, sf_dir)
    metrics = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed"]
    return o.groupBy("datetime", CITY).agg(
        *[F.avg(m).alias(m) for m in metrics],
        F.max_by(classify_description("weather_description"), F.col("obs_id")).alias("weather_condition"))


def fx_obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumn("datetime", truncate_hour("datetime"))


def write_wide_csvs(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    """One wide CSV per metric (``datetime`` + one column per station), like the source files."""
    means = hourly_station_means(spark, sf_dir).persist()
    try:
        stations = sorted(r[0] for r in means.select(CITY).distinct().limit(MAX_STATIONS + 1).collect())
        if len(stations) > MAX_STATIONS:
            raise ValueError(f"a wide table has {MAX_STATIONS} places at most")
        for name, file in WIDE_FILES.items():
            wide = means.groupBy("datetime").pivot(CITY, stations).agg(F.first(name))
            wide.write.mode("overwrite").option("header", True).csv(f"{out_dir}/{file}.csv")
    finally:
        means.unpersist()
    return out_dir


def write_places_csv(spark: SparkSession, sf_dir: str, path: str) -> str:
    places(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return path


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province records as text; every 7th key (n % 7 = 3) has an unusable latitude."""
    n = table(spark, sf_dir, "nation")
    lat = (n.n_nationkey * 1.5).cast("double").cast("string")
    return n.select(
        F.concat(F.lit(STATION_PREFIX), F.col("n_nationkey").cast("string")).alias("province_name"),
        F.when(F.col("n_nationkey") % 7 == 3, F.lit("n/a")).otherwise(lat).alias("latitude"),
        (F.lit(100.0) + F.col("n_nationkey") * 0.5).cast("double").alias("longitude"))


def write_provinces_json(spark: SparkSession, sf_dir: str, path: str) -> str:
    """One JSON array (``nation`` has 25 rows at every scale)."""
    whole = provinces(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_history_csv(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The store rows as a CSV history with a header; every 41st timestamp is unreadable."""
    rows = store_rows(spark, sf_dir)
    text = F.when(F.col("seq") % 41 == 0, F.lit("soon")).otherwise(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    rows.withColumn("datetime", text).drop("seq").write.mode("overwrite").option("header", True).csv(path)
    return path


def class_probabilities(spark: SparkSession, sf_dir: str, classes: list[str]) -> DataFrame:
    """(obs_id, y, p): the row's class and a probability per class, weights by id over their sum."""
    weights = F.array(*[(F.col("obs_id") * (i + 3) % 17).cast("double") for i in range(len(classes))])
    total = F.aggregate(weights, F.lit(1.0), lambda a, x: a + x)
    return obs(spark, sf_dir).select("obs_id", classify_description("weather_description").alias("y"),
                                     F.transform(weights, lambda x: x / total).alias("p"))


def _text(c: Column) -> Column:
    return c.cast("string")


def history_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical payloads of a station and day, each with the ``obs`` rows of at most
    PAYLOAD_IDS consecutive ids as hourly entries; ``record`` is the number of the run of ids."""
    o = obs_celsius(spark, sf_dir)
    hourly = F.struct(
        _text(F.hour("datetime") * 100).alias("time"),
        _text(F.col("humidity")).alias("humidity"),
        _text(F.col("pressure")).alias("pressure"),
        _text(F.col("temp_c")).alias("tempC"),
        _text(F.col("wind_direction")).alias("winddirDegree"),
        _text(F.col("wind_speed")).alias("windspeedKmph"),
        F.array(F.struct(F.col("weather_description").alias("value"))).alias("weatherDesc"),
    )
    per_day = (o.withColumn("date", F.date_format("datetime", "yyyy-MM-dd"))
                .groupBy(CITY, "date", F.floor(F.col("obs_id") / PAYLOAD_IDS).cast("long").alias("record"))
                .agg(F.sort_array(F.collect_list(F.struct(F.col("datetime").alias("_ts"), F.col("obs_id").alias("_id"),
                                                          hourly.alias("h")))).alias("hs")))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("date").alias("date"), F.transform("hs", lambda x: x.getField("h")).alias("hourly"))).alias("weather"))
        .alias("data")))
    p = places(spark, sf_dir)
    return (per_day.select(F.col(CITY).alias("province"), "record", payload.alias("payload"))
            .join(p.select(F.col(CITY).alias("province"), F.col("Latitude").alias("latitude"),
                           F.col("Longitude").alias("longitude")), "province"))


def current_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current-conditions payload per ``obs`` row. Every 50th has an empty
    ``current_condition``; n % 50 = 7 carries a non-numeric humidity."""
    o = spread_events(spark, sf_dir).select(*_obs_columns(), (F.col("value") / 10).alias("temp_c"))
    humidity = F.when(F.col("obs_id") % 50 == 7, F.lit("abc")).otherwise(_text(F.col("humidity")))
    cond = F.struct(
        _text(F.col("temp_c")).alias("temp_C"),
        humidity.alias("humidity"),
        _text(F.col("pressure")).alias("pressure"),
        _text(F.col("wind_speed")).alias("windspeedKmph"),
        _text(F.col("wind_direction")).alias("winddirDegree"),
        F.date_format("datetime", "hh:mm a").alias("observation_time"),
        F.array(F.struct(F.col("weather_description").alias("value"))).alias("weatherDesc"),
    )
    conds = F.when(F.col("obs_id") % 50 == 0, F.array().cast(f"array<{cond_type()}>")).otherwise(F.array(cond))
    payload = F.to_json(F.struct(F.struct(conds.alias("current_condition")).alias("data")))
    p = places(spark, sf_dir).select(CITY, F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"))
    return o.join(p, CITY).select("obs_id", "latitude", "longitude", payload.alias("payload"))


def cond_type() -> str:
    fields = ["temp_C", "humidity", "pressure", "windspeedKmph", "winddirDegree", "observation_time"]
    return "struct<" + ",".join(f"{f}:string" for f in fields) + ",weatherDesc:array<struct<value:string>>>"


def timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, raw) timestamp strings; n % 17 = 0 is garbage, n % 17 = 1 an impossible date."""
    o = obs(spark, sf_dir)
    raw = (F.when(F.col("obs_id") % 17 == 0, F.lit("not a time"))
            .when(F.col("obs_id") % 17 == 1, F.lit("2024-02-30 10:00:00"))
            .otherwise(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")))
    return o.select("obs_id", raw.alias("raw"))


def numeric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, raw) humidity strings; n % 13 = 0 'abc', 1 'NaN', 2 empty."""
    o = obs(spark, sf_dir)
    m = F.col("obs_id") % 13
    raw = (F.when(m == 0, F.lit("abc")).when(m == 1, F.lit("NaN")).when(m == 2, F.lit(""))
            .otherwise(F.col("humidity").cast("string")))
    return o.select("obs_id", raw.alias("raw"))


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, temp_c, wind_kmph) as measured before conversion."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("obs_id"), (F.col("value") / 10).alias("temp_c"),
                     ((F.col("event_id") * 11) % 25).cast("double").alias("wind_kmph"))


def write_landing(spark: SparkSession, sf_dir: str, landing: str, n_files: int = 4, broken: bool = False) -> str:
    """History payloads as JSON-lines landing files (province, latitude, longitude, payload). With
    ``broken`` every payload comes a second time without its second half."""
    rows = history_payloads(spark, sf_dir).select("province", "latitude", "longitude", "record", "payload")
    if broken:
        half = F.expr("substring(payload, 1, length(payload) div 2)")
        rows = rows.select(*rows.columns[:-1], F.explode(F.array("payload", half)).alias("payload"))
    rows.repartition(n_files, "province").write.mode("overwrite").json(landing)
    return landing
