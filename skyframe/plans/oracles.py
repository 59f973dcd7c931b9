"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the provided tables as views. Doubles are rounded to 8
decimals on both sides; integers are cast to the Spark result's width.
"""

from __future__ import annotations

R = 8  # decimals

# Everything the jobs are checked against is written out here; nothing is taken from their code.
METRICS = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed"]
CALENDAR_COLS = ["hour", "dayofweek", "dayofyear", "month", "year", "hour_sin", "hour_cos", "dayofyear_sin",
                 "dayofyear_cos"]
LAG_STEPS = [1, 3, 6, 12, 24, 48]
MIN_PERIODS = {6: 3, 12: 6, 24: 12, 48: 24}  # by window size
TARGET = "target_weather_condition_24h"


def lag_name(col: str, k: int) -> str:
    return f"{col}_lag_{k}h"


def window_name(col: str, size: int) -> str:
    return f"{col}_win_{size}h_mean"


NUMERIC_LAG_COLS = [lag_name(c, k) for c in METRICS for k in LAG_STEPS]
LABEL_LAG_COLS = [lag_name("weather_condition", k) for k in LAG_STEPS]
WINDOW_SIZES = list(MIN_PERIODS)
WINDOW_COLS = [window_name(c, w) for c in METRICS for w in WINDOW_SIZES]


def classify_sql(x: str) -> str:
    low = f"lower({x})"
    return f"""(CASE WHEN regexp_matches({low}, 'squall|thunderstorm') THEN 'thunderstorm'
      WHEN regexp_matches({low}, 'drizzle|rain') THEN 'rainy'
      WHEN regexp_matches({low}, 'sleet|snow') THEN 'snowy'
      WHEN regexp_matches({low}, 'cloud|overcast') THEN 'cloudy'
      WHEN regexp_matches({low}, 'fog|mist|haze|smoke|dust') THEN 'foggy'
      WHEN regexp_matches({low}, 'clear|sun') THEN 'sunny' ELSE 'unknown' END)"""


def description_sql(eid: str) -> str:
    return f"""(CASE ({eid}) % 12 WHEN 0 THEN 'Light rain' WHEN 1 THEN 'Thunderstorm with heavy rain'
      WHEN 2 THEN 'Light snow' WHEN 3 THEN 'Partly Cloudy' WHEN 4 THEN 'Mist' WHEN 5 THEN 'Clear'
      WHEN 6 THEN 'sky is clear' WHEN 7 THEN 'overcast clouds' WHEN 8 THEN 'Light rain and snow'
      WHEN 9 THEN 'Thundery outbreaks possible' WHEN 10 THEN 'Blizzard' END)"""


OBS = f"""obs AS (
  SELECT event_id AS obs_id, ts AS datetime,
    concat('station_', CAST(user_id % 10 AS VARCHAR)) AS City,
    CAST((event_id * 7) % 101 AS DOUBLE) AS humidity,
    CAST(980 + (event_id * 13) % 60 AS DOUBLE) AS pressure,
    273.15e0 + value / 10 AS temperature,
    CAST((event_id * 37) % 360 AS DOUBLE) AS wind_direction,
    CAST((event_id * 11) % 25 AS DOUBLE) AS wind_speed,
    {description_sql('event_id')} AS weather_description
  FROM events)"""

CLEAN = f"""clean AS (
  SELECT obs_id, datetime, City, humidity, pressure, temperature, wind_direction, wind_speed,
         {classify_sql('weather_description')} AS weather_condition
  FROM obs
  WHERE humidity IS NOT NULL AND pressure IS NOT NULL AND temperature IS NOT NULL
    AND wind_direction IS NOT NULL AND wind_speed IS NOT NULL AND City IS NOT NULL AND datetime IS NOT NULL
    AND {classify_sql('weather_description')} <> 'unknown')"""

PLACES = """places AS (
  SELECT concat('station_', CAST(n_nationkey AS VARCHAR)) AS City, n_name AS Country,
         CAST(n_nationkey * 1.5 AS DOUBLE) AS Latitude, CAST(100.0 + n_nationkey * 0.5 AS DOUBLE) AS Longitude
  FROM nation)"""

# cleaned observations with coordinates: the training table
TRAIN_TABLE = """tt AS (
  SELECT c.obs_id, c.datetime, c.City, c.humidity, c.pressure, c.temperature, c.wind_direction,
         c.wind_speed, p.Latitude AS latitude, p.Longitude AS longitude, c.weather_condition
  FROM clean c JOIN places p ON c.City = p.City)"""


def rnd(x: str) -> str:
    return f"round({x}, {R})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


W = "PARTITION BY City ORDER BY datetime"


def _lag_sql(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER ({W})"


def _mean_sql(col: str, size: int) -> str:
    frame = f"({W} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) OVER {frame} >= {MIN_PERIODS[size]} THEN avg({col}) OVER {frame} END"


def calendar_sql(ts: str = "datetime") -> dict[str, str]:
    return {
        "hour": f"CAST(hour({ts}) AS INTEGER)",
        "dayofweek": f"CAST(isodow({ts}) - 1 AS INTEGER)",
        "dayofyear": f"CAST(dayofyear({ts}) AS INTEGER)",
        "month": f"CAST(month({ts}) AS INTEGER)",
        "year": f"CAST(year({ts}) AS INTEGER)",
        "hour_sin": f"sin(2 * pi() * hour({ts}) / 24.0)",
        "hour_cos": f"cos(2 * pi() * hour({ts}) / 24.0)",
        "dayofyear_sin": f"sin(2 * pi() * dayofyear({ts}) / 365.25)",
        "dayofyear_cos": f"cos(2 * pi() * dayofyear({ts}) / 365.25)",
    }


def _double_cols():
    return set(METRICS) | set(NUMERIC_LAG_COLS) | set(WINDOW_COLS) | {
        "hour_sin", "hour_cos", "dayofyear_sin", "dayofyear_cos"}


def _exact_sql(col: str, hours: int) -> str:
    """The value exactly ``hours`` hours later (earlier if negative)."""
    bound = f"INTERVAL {abs(hours)} HOURS {'FOLLOWING' if hours > 0 else 'PRECEDING'}"
    return f"first({col}) OVER ({W} RANGE BETWEEN {bound} AND {bound})"


def _exact_mean_sql(col: str, size: int) -> str:
    frame = f"({W} RANGE BETWEEN INTERVAL {size} HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    return f"CASE WHEN count({col}) OVER {frame} >= {MIN_PERIODS[size]} THEN avg({col}) OVER {frame} END"


FEAT = (f"feat AS (SELECT *, lead(weather_condition, 24) OVER ({W}) AS {TARGET}, "
        + ", ".join(f"{_lag_sql(c, k)} AS {lag_name(c, k)}" for c in [*METRICS, "weather_condition"]
                    for k in LAG_STEPS)
        + ", " + ", ".join(f"{_mean_sql(c, s)} AS {window_name(c, s)}" for c in METRICS for s in WINDOW_SIZES)
        + ", " + ", ".join(f"{v} AS {k}" for k, v in calendar_sql().items())
        + " FROM clean)")

FORECAST_COLS = ["obs_id", "datetime", "City", *METRICS, "weather_condition", TARGET, *NUMERIC_LAG_COLS,
                 *LABEL_LAG_COLS, *WINDOW_COLS, *CALENDAR_COLS]


def _select(cols, doubles) -> str:
    return ", ".join(rnd(c) + f" AS {c}" if c in doubles else c for c in cols)


FORECAST_WHERE = " AND ".join(f"{c} IS NOT NULL" for c in [TARGET, *NUMERIC_LAG_COLS, *LABEL_LAG_COLS, *WINDOW_COLS])

FORECAST_SQL = (with_(OBS, CLEAN, FEAT)
                + f"SELECT {_select(FORECAST_COLS, _double_cols())} FROM feat WHERE {FORECAST_WHERE}")

FORECAST_CTE = f"ff AS (SELECT * FROM feat WHERE {FORECAST_WHERE})"

CLEAN_COLS = ["obs_id", "datetime", "City", *METRICS, "weather_condition"]


def obs_queries() -> dict[str, str]:
    doubles = _double_cols()
    q = {}
    q["classify_description"] = (with_(OBS) + "SELECT obs_id, weather_description, "
                                 + classify_sql("weather_description") + " AS weather_condition FROM obs")
    q["clean_observations"] = with_(OBS, CLEAN) + f"SELECT {_select(CLEAN_COLS, doubles)} FROM clean"
    q["cleaning_audit"] = with_(OBS) + f"""SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE humidity IS NULL OR pressure IS NULL OR temperature IS NULL OR wind_direction IS NULL
                   OR wind_speed IS NULL OR City IS NULL OR datetime IS NULL) AS dropped_null,
  count(*) FILTER (WHERE NOT (humidity IS NULL OR pressure IS NULL OR temperature IS NULL OR wind_direction IS NULL
                   OR wind_speed IS NULL OR City IS NULL OR datetime IS NULL)
                   AND {classify_sql('weather_description')} = 'unknown') AS dropped_unknown,
  count(*) FILTER (WHERE NOT (humidity IS NULL OR pressure IS NULL OR temperature IS NULL OR wind_direction IS NULL
                   OR wind_speed IS NULL OR City IS NULL OR datetime IS NULL)
                   AND {classify_sql('weather_description')} <> 'unknown') AS rows_kept
FROM obs"""
    feats = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed", "latitude", "longitude"]
    q["select_features"] = (with_(OBS, CLEAN, PLACES, TRAIN_TABLE)
                            + "SELECT obs_id, " + ", ".join(f"{rnd(c)} AS {c}" for c in feats) + " FROM tt")
    lead = (with_(OBS, CLEAN) + f"SELECT * FROM (SELECT obs_id, datetime, City, weather_condition, "
            f"lead(weather_condition, 24) OVER ({W}) AS {TARGET} FROM clean) t "
            f"WHERE {TARGET} IS NOT NULL")
    q["lead_target"] = lead
    q["lag_features"] = (with_(OBS, CLEAN) + "SELECT obs_id, datetime, City, "
                         + ", ".join((rnd(_lag_sql(c, k)) if c in METRICS else _lag_sql(c, k)) + f" AS {lag_name(c, k)}"
                                     for c in [*METRICS, "weather_condition"] for k in LAG_STEPS)
                         + " FROM clean")
    q["rolling_means"] = (with_(OBS, CLEAN) + "SELECT obs_id, datetime, City, "
                          + ", ".join(f"{rnd(_mean_sql(c, s))} AS {window_name(c, s)}"
                                      for c in METRICS for s in WINDOW_SIZES) + " FROM clean")
    cal = calendar_sql()
    q["calendar_features"] = (with_(OBS) + "SELECT obs_id, datetime, "
                              + ", ".join((rnd(v) if k.endswith(("_sin", "_cos")) else v) + f" AS {k}"
                                          for k, v in cal.items()) + " FROM obs")
    q["forecast_features"] = FORECAST_SQL
    q["label_counts"] = with_(OBS, CLEAN) + "SELECT weather_condition, count(*) AS n FROM clean GROUP BY 1"
    q["label_shares"] = (with_(OBS, CLEAN) + f"SELECT weather_condition, n, {rnd('n / sum(n) OVER ()')} AS share "
                         "FROM (SELECT weather_condition, count(*) AS n FROM clean GROUP BY 1) t")
    q["label_domain"] = (with_(OBS, CLEAN, FEAT, FORECAST_CTE) + "SELECT DISTINCT label FROM ("
                         + " UNION ALL ".join(f"SELECT {c} AS label FROM ff" for c in [TARGET, *LABEL_LAG_COLS])
                         + ") u")
    q["coverage"] = (with_(OBS) + "SELECT City, grouping(City) = 1 AS is_total, min(datetime) AS first_datetime, max(datetime) AS last_datetime, "
                     "count(*) AS n_rows FROM obs GROUP BY ROLLUP (City)")
    q["day_slice"] = (with_(OBS) + "SELECT obs_id, datetime, City, " + ", ".join(f"{rnd(c)} AS {c}" for c in METRICS)
                      + ", weather_description FROM obs WHERE CAST(datetime AS DATE) = DATE '2024-01-15'")
    return q


STATIONS = [f"station_{i}" for i in range(10)]
WIDE = ["humidity", "pressure", "temperature", "weather_condition", "wind_direction", "wind_speed"]

HOURLY = f"""h AS (
  SELECT date_trunc('hour', datetime) AS datetime, City, avg(humidity) AS humidity, avg(pressure) AS pressure,
         avg(temperature) AS temperature, avg(wind_direction) AS wind_direction, avg(wind_speed) AS wind_speed,
         arg_max({classify_sql('weather_description')}, obs_id) AS weather_condition
  FROM obs GROUP BY 1, 2)"""

GRID = """g AS (SELECT hh.datetime, s.City FROM (SELECT DISTINCT datetime FROM h) hh, (SELECT DISTINCT City FROM h) s)"""

LONG = """lng AS (SELECT g.datetime, g.City, h.humidity, h.pressure, h.temperature, h.weather_condition,
                       h.wind_direction, h.wind_speed FROM g LEFT JOIN h USING (datetime, City))"""

MERGED_COLS = ["datetime", "City", "humidity", "pressure", "temperature", "weather_condition", "wind_direction",
               "wind_speed"]
_MERGED_DOUBLES = {"humidity", "pressure", "temperature", "wind_direction", "wind_speed", "Latitude", "Longitude",
                   "latitude", "longitude"}

MONTHS = """(SELECT greatest(CAST(m AS DATE), s) AS range_start, least(CAST(last_day(m) AS DATE), e) AS range_end
             FROM (SELECT s, e, unnest(generate_series(CAST(date_trunc('month', s) AS TIMESTAMP), CAST(e AS TIMESTAMP),
                                                      INTERVAL 1 MONTH)) AS m FROM b) t)"""

KMPH = "(10e0 / 36e0)"


def source_queries() -> dict[str, str]:
    q = {}
    numbers = [m for m in WIDE if m != "weather_condition"]
    def cell(c, v):
        return f"max({v}) FILTER (WHERE City = '{c}')"
    q["src_wide_csv"] = with_(OBS, HOURLY) + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, datetime, "
        + ", ".join((rnd(cell(c, m)) if m in numbers else "CAST(NULL AS DOUBLE)") + f" AS {c}, "
                    + ("CAST(NULL AS VARCHAR)" if m in numbers else cell(c, m)) + f" AS {c}_text" for c in STATIONS)
        + " FROM h GROUP BY datetime" for m in WIDE)
    q["wide_to_long"] = with_(OBS, HOURLY, GRID, LONG) + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, datetime, City, "
        + (f"{rnd(m)} AS value, CAST(NULL AS VARCHAR) AS value_text" if m in numbers
           else f"CAST(NULL AS DOUBLE) AS value, {m} AS value_text") + " FROM lng" for m in WIDE)
    q["join_metrics"] = with_(OBS, HOURLY, GRID, LONG) + f"SELECT {_select(MERGED_COLS, _MERGED_DOUBLES)} FROM lng"
    classed = f"x AS (SELECT * REPLACE ({classify_sql('weather_condition')} AS weather_condition) FROM lng WHERE temperature IS NOT NULL)"
    q["exact_time_features"] = with_(OBS, HOURLY, GRID, LONG, classed) + (
        f"SELECT datetime, City, {_exact_sql('weather_condition', 24)} AS {TARGET}, "
        + ", ".join((rnd(_exact_sql(c, -k)) if c in METRICS else _exact_sql(c, -k)) + f" AS {lag_name(c, k)}"
                    for c in [*METRICS, "weather_condition"] for k in LAG_STEPS) + ", "
        + ", ".join(f"{rnd(_exact_mean_sql(c, s))} AS {window_name(c, s)}" for c in METRICS for s in WINDOW_SIZES) + " FROM x")
    q["join_places"] = (with_(OBS, HOURLY, GRID, LONG, PLACES)
                        + f"SELECT {_select(MERGED_COLS + ['Latitude', 'Longitude'], _MERGED_DOUBLES)} "
                          "FROM lng JOIN places USING (City)")
    q["fetch_plan"] = (with_(PLACES, "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, "
                                     "CAST(max(o_orderdate) AS DATE) AS e FROM orders)")
                       + "SELECT p.City AS province_name, round(p.Latitude, 8) AS latitude, "
                         f"round(p.Longitude, 8) AS longitude, m.range_start, m.range_end FROM places p, {MONTHS} m")
    q["month_ranges"] = """SELECT o_custkey, greatest(CAST(m AS DATE), s) AS range_start,
       least(CAST(last_day(m) AS DATE), e) AS range_end
FROM (SELECT o_custkey, s, e, unnest(generate_series(CAST(date_trunc('month', s) AS TIMESTAMP), CAST(e AS TIMESTAMP),
                                                     INTERVAL 1 MONTH)) AS m
      FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e
            FROM orders GROUP BY o_custkey) b) t"""
    q["src_places_csv"] = with_(PLACES) + "SELECT City, round(Latitude, 8) AS Latitude, round(Longitude, 8) AS Longitude FROM places"
    q["src_places_json"] = ("SELECT concat('station_', CAST(n_nationkey AS VARCHAR)) AS province_name, "
                            "round(CAST(n_nationkey * 1.5 AS DOUBLE), 8) AS latitude, "
                            "round(CAST(100.0 + n_nationkey * 0.5 AS DOUBLE), 8) AS longitude "
                            "FROM nation WHERE n_nationkey % 7 <> 3")
    q["parse_history_json"] = (with_(OBS, PLACES) + f"""SELECT date_trunc('hour', o.datetime) AS datetime, o.City AS province,
  round(o.humidity, 8) AS humidity, round(p.Latitude, 8) AS latitude, round(p.Longitude, 8) AS longitude,
  round(o.pressure, 8) AS pressure, round(e.value / 10 + 273.15e0, 8) AS temperature,
  {classify_sql('o.weather_description')} AS weather_condition, round(o.wind_direction, 8) AS wind_direction,
  round(round(o.wind_speed * {KMPH}, 2), 8) AS wind_speed
FROM obs o JOIN events e ON e.event_id = o.obs_id JOIN places p ON p.City = o.City""")
    q["parse_current_json"] = (with_(OBS, PLACES) + f"""SELECT o.obs_id, round(p.Latitude, 8) AS latitude,
  round(p.Longitude, 8) AS longitude, strftime(o.datetime, '%I:%M %p') AS observed_time_utc,
  round(e.value / 10, 8) AS temperature_celsius, round(e.value / 10 + 273.15e0, 8) AS temperature_kelvin,
  CASE WHEN o.obs_id % 50 = 7 THEN NULL ELSE round(o.humidity, 8) END AS humidity,
  round(o.pressure, 8) AS pressure, round(round(o.wind_speed * {KMPH}, 2), 8) AS wind_speed_mps,
  round(o.wind_direction, 8) AS wind_direction_degree,
  CASE WHEN o.weather_description IS NULL OR o.weather_description = '' THEN 'unknown'
       ELSE {classify_sql('o.weather_description')} END AS weather_condition
FROM obs o JOIN events e ON e.event_id = o.obs_id JOIN places p ON p.City = o.City
WHERE o.obs_id % 50 <> 0""")
    q["parse_timestamps"] = (with_(OBS) + """SELECT * FROM (
  SELECT obs_id, raw, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS datetime FROM (
    SELECT obs_id, CASE WHEN obs_id % 17 = 0 THEN 'not a time' WHEN obs_id % 17 = 1 THEN '2024-02-30 10:00:00'
                        ELSE strftime(datetime, '%Y-%m-%d %H:%M:%S') END AS raw FROM obs) t) u
WHERE datetime IS NOT NULL""")
    q["numeric_coercion"] = (with_(OBS) + "SELECT obs_id, CASE WHEN obs_id % 13 IN (0, 1, 2) THEN NULL "
                             "ELSE round(humidity, 8) END AS humidity FROM obs")
    q["unit_conversions"] = (f"SELECT event_id AS obs_id, round(value / 10 + 273.15e0, 8) AS temperature, "
                             f"round(round(CAST((event_id * 11) % 25 AS DOUBLE) * {KMPH}, 2), 8) AS wind_speed FROM events")
    return q


def store_rows_sql(changed: bool) -> str:
    value = "(CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END)" if changed else "value"
    return f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
    concat('province_', CAST(user_id AS VARCHAR)) AS province,
    CAST((event_id * 7) % 101 AS DOUBLE) AS humidity, CAST(user_id % 90 AS DOUBLE) AS latitude,
    CAST(100 + user_id % 10 AS DOUBLE) AS longitude, CAST(980 + (event_id * 13) % 60 AS DOUBLE) AS pressure,
    273.15e0 + {value} / 10 AS temperature, {classify_sql(description_sql('event_id'))} AS weather_condition,
    CAST((event_id * 37) % 360 AS DOUBLE) AS wind_direction, CAST((event_id * 11) % 25 AS DOUBLE) AS wind_speed,
    event_id AS seq
  FROM events"""


STORE_CTES = [
    f"base AS (SELECT * FROM ({store_rows_sql(False)}) r WHERE day(datetime) BETWEEN 1 AND 20)",
    f"batch AS (SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN NULL ELSE province END AS province) "
    f"FROM ({store_rows_sql(True)}) r WHERE day(datetime) BETWEEN 15 AND 31)",
    "tgt AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY seq DESC) AS rn "
    "FROM base) x WHERE rn = 1)",
    "bd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY seq DESC) AS rn "
    "FROM batch WHERE datetime IS NOT NULL AND province IS NOT NULL) x WHERE rn = 1)",
]
CORRECTION = f"""fix AS (SELECT datetime, CASE WHEN seq % 89 <> 0 THEN province END AS province,
    CASE WHEN seq % 31 = 0 THEN NULL ELSE humidity END AS humidity, latitude, longitude, pressure,
    temperature + 1 AS temperature, weather_condition, wind_direction, wind_speed, seq
  FROM ({store_rows_sql(False)}) r WHERE day(datetime) BETWEEN 12 AND 22 AND seq % 5 = 0),
fd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY seq DESC) AS rn
  FROM fix WHERE province IS NOT NULL) x WHERE rn = 1)"""
STORE_VALUE_COLS = ["humidity", "latitude", "longitude", "pressure", "temperature", "weather_condition",
                    "wind_direction", "wind_speed"]
_STORE_DOUBLES = {"humidity", "latitude", "longitude", "pressure", "temperature", "wind_direction", "wind_speed"}


def _upsert_select() -> str:
    cols = ["coalesce(b.datetime, t.datetime) AS datetime", "coalesce(b.province, t.province) AS province"]
    for c in STORE_VALUE_COLS:
        e = f"CASE WHEN b.province IS NOT NULL THEN b.{c} ELSE t.{c} END"
        cols.append((rnd(e) if c in _STORE_DOUBLES else e) + f" AS {c}")
    return ", ".join(cols)


SPLIT = """sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY weather_condition
      ORDER BY md5(concat(CAST(obs_id AS VARCHAR), '#42')), obs_id)
      <= round(0.2 * count(*) OVER (PARTITION BY weather_condition)) THEN 'test' ELSE 'train' END AS split FROM tt)"""

FEATS = ["humidity", "pressure", "temperature", "wind_direction", "wind_speed", "latitude", "longitude"]

PAIRS_OBS = (f"pairs AS (SELECT {classify_sql(description_sql('event_id'))} AS y, "
             f"{classify_sql(description_sql('event_id + 1'))} AS yhat FROM events)")
PAIRS_LABELS = "pairs AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS yhat FROM labels)"

REPORT = """cc AS (SELECT y, yhat, count(*) AS n FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1, 2),
t AS (SELECT y AS label, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS tp FROM cc GROUP BY y),
p AS (SELECT yhat AS label, sum(n) AS predicted FROM cc GROUP BY yhat),
per AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
        FROM t FULL JOIN p USING (label)),
m AS (SELECT label, support,
        CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1,
        sum(tp) OVER () / sum(support) OVER () AS accuracy FROM per)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
       CAST(support AS BIGINT) AS support, round(accuracy, 8) AS accuracy FROM m
UNION ALL
SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), CAST(sum(support) AS BIGINT),
       round(max(accuracy), 8) FROM m
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8),
       round(sum(f1 * support) / sum(support), 8), CAST(sum(support) AS BIGINT), round(max(accuracy), 8) FROM m"""

CONFUSION = """cc AS (SELECT y, yhat, count(*) AS n FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1, 2),
cls AS (SELECT y AS c FROM cc UNION SELECT yhat FROM cc),
full_grid AS (SELECT a.c AS y, b.c AS yhat, CAST(coalesce(cc.n, 0) AS BIGINT) AS n
              FROM cls a CROSS JOIN cls b LEFT JOIN cc ON cc.y = a.c AND cc.yhat = b.c)"""


def store_and_ml_queries() -> dict[str, str]:
    q = {}
    sel = ", ".join(["datetime", "province"] + [rnd(c) + f" AS {c}" if c in _STORE_DOUBLES else c
                                                for c in STORE_VALUE_COLS])
    q["merge_day_into_base"] = (with_(*STORE_CTES) + f"""SELECT {sel} FROM (
  SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY src DESC, seq DESC) AS rn FROM (
    SELECT *, 0 AS src FROM ({store_rows_sql(False)}) r
    UNION ALL SELECT *, 1 AS src FROM batch WHERE CAST(datetime AS DATE) = DATE '2024-01-18') u) x WHERE rn = 1""")
    up = with_(*STORE_CTES) + f"SELECT {_upsert_select()} FROM tgt t FULL JOIN bd b ON t.datetime = b.datetime AND t.province = b.province"
    q["upsert_store"] = up
    q["store_day_slice"] = f"SELECT * FROM ({up}) u WHERE CAST(datetime AS DATE) = DATE '2024-01-18'"
    last = "CASE WHEN f.province IS NOT NULL THEN f.{c} WHEN b.province IS NOT NULL THEN b.{c} ELSE t.{c} END"
    q["store_scan"] = (with_(*STORE_CTES, CORRECTION) + "SELECT coalesce(f.datetime, b.datetime, t.datetime) AS datetime, "
                       "coalesce(f.province, b.province, t.province) AS province, "
                       + ", ".join((rnd(last.format(c=c)) if c in _STORE_DOUBLES else last.format(c=c)) + f" AS {c}"
                                   for c in STORE_VALUE_COLS)
                       + """ FROM tgt t FULL JOIN bd b ON t.datetime = b.datetime AND t.province = b.province
  FULL JOIN fd f ON f.datetime = coalesce(b.datetime, t.datetime) AND f.province = coalesce(b.province, t.province)""")
    q["history_csv"] = f"SELECT {sel} FROM ({store_rows_sql(False)}) r WHERE seq % 41 <> 0"
    same = " AND ".join(f"t.{c} IS NOT DISTINCT FROM b.{c}" for c in STORE_VALUE_COLS)
    q["upsert_counts"] = (with_(*STORE_CTES) + f"""SELECT
  count(*) FILTER (WHERE b.province IS NOT NULL AND t.province IS NULL) AS inserted,
  count(*) FILTER (WHERE b.province IS NOT NULL AND t.province IS NOT NULL) AS matched,
  count(*) FILTER (WHERE b.province IS NOT NULL AND t.province IS NOT NULL AND NOT ({same})) AS modified,
  (SELECT count(*) FROM batch WHERE datetime IS NULL OR province IS NULL) AS skipped,
  count(*) FILTER (WHERE b.province IS NOT NULL AND t.province IS NULL)
    + count(*) FILTER (WHERE b.province IS NOT NULL AND t.province IS NOT NULL AND NOT ({same})) AS saved
FROM tgt t FULL JOIN bd b ON t.datetime = b.datetime AND t.province = b.province""")
    base_ctes = [OBS, CLEAN, PLACES, TRAIN_TABLE]
    q["stratified_split"] = with_(*base_ctes, SPLIT) + "SELECT obs_id, weather_condition, split FROM sp"
    q["undersample"] = (with_(*base_ctes) + """SELECT obs_id, weather_condition FROM (
  SELECT obs_id, weather_condition,
         row_number() OVER (PARTITION BY weather_condition ORDER BY md5(concat(CAST(obs_id AS VARCHAR), '#42')), obs_id) AS rn,
         min(n) OVER () AS minority
  FROM (SELECT *, count(*) OVER (PARTITION BY weather_condition) AS n FROM tt) a) b WHERE rn <= minority""")
    enc_in = [TARGET, *LABEL_LAG_COLS]
    enc_out = ["target_encoded_24h", *[f"{c}_encoded" for c in LABEL_LAG_COLS]]
    dom = ("dom AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM ("
           + " UNION ".join(f"SELECT {c} AS label FROM ff" for c in enc_in) + ") u)")
    joins = " ".join(f"JOIN dom d{i} ON d{i}.label = ff.{c}" for i, c in enumerate(enc_in))
    q["encode_labels"] = (with_(OBS, CLEAN, FEAT, FORECAST_CTE, dom) + "SELECT ff.obs_id, "
                          + ", ".join(f"d{i}.code AS {o}" for i, o in enumerate(enc_out)) + f" FROM ff {joins}")
    q["decode_labels"] = (with_(OBS, CLEAN, FEAT, FORECAST_CTE) + f"SELECT obs_id, {TARGET} AS target_decoded FROM ff")
    q["scaler_stats"] = (with_(*base_ctes, SPLIT) + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 8) AS mean, round(stddev_pop({c}), 8) AS std_pop, count(*) AS n "
        f"FROM sp WHERE split = 'train'" for c in FEATS))
    stats = ("st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL "
                                          f"THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in FEATS)
             + " FROM sp WHERE split = 'train')")
    q["standard_scale"] = (with_(*base_ctes, SPLIT, stats) + "SELECT obs_id, split, "
                           + ", ".join(f"round(({c} - m_{c}) / s_{c}, 8) AS {c}" for c in FEATS) + " FROM sp, st")
    q["classification_report"] = "WITH " + PAIRS_OBS + ",\n" + REPORT
    q["classification_report_binary"] = "WITH " + PAIRS_LABELS + ",\n" + REPORT
    q["confusion_matrix"] = with_(PAIRS_OBS, CONFUSION) + "SELECT y, yhat, n FROM full_grid"
    q["confusion_matrix_binary"] = with_(PAIRS_LABELS, CONFUSION) + "SELECT y, yhat, n FROM full_grid"
    q["confusion_matrix_norm"] = (with_(PAIRS_OBS, CONFUSION) + """SELECT y, yhat,
  round(CASE WHEN sum(n) OVER (PARTITION BY y) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY y) END, 8) AS rate
FROM full_grid""")
    return q


CLASSES = ["cloudy", "foggy", "rainy", "snowy", "sunny", "thunderstorm"]

# parameters that take effect in a random forest: 150 trees of depth 7 for the full refit
FULL_REFIT = "colsample_bytree=0.8;gamma=0;max_depth=7;min_child_weight=1;n_estimators=150;random_state=42;subsample=0.8"

FORECAST_FEATURES = (METRICS + ["Latitude", "Longitude"] + NUMERIC_LAG_COLS + [f"{c}_encoded" for c in LABEL_LAG_COLS]
                     + WINDOW_COLS + CALENDAR_COLS)


def supports_sql(split_cte: str, label: str) -> str:
    """Label, support of the test rows, with the two averages."""
    return f"""SELECT {label} AS label, count(*) AS support FROM {split_cte} WHERE split = 'test' GROUP BY 1
UNION ALL SELECT a, (SELECT count(*) FROM {split_cte} WHERE split = 'test') FROM (VALUES ('macro avg'), ('weighted avg')) v(a)"""


def model_queries() -> dict[str, str]:
    q = {}
    base = [OBS, CLEAN, PLACES, TRAIN_TABLE]
    weights = [f"CAST((event_id * {i + 3}) % 17 AS DOUBLE)" for i in range(6)]
    y = classify_sql(description_sql("event_id"))
    p = "CASE y " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in zip(CLASSES, weights)) + " END / (1 + " + " + ".join(weights) + ")"
    q["log_loss"] = (f"SELECT round(avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, {p})))), 8) AS log_loss, "
                     f"count(*) AS n FROM (SELECT event_id, {y} AS y FROM events) e WHERE y <> 'unknown'")
    last = "(SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY seq DESC) AS rn FROM (" + store_rows_sql(False) + ") r)"
    key = "concat(CAST(datetime AS VARCHAR), '|', province)"
    q["train_full"] = f"""WITH hist AS (SELECT *, {key} AS k FROM {last} x WHERE rn = 1 AND weather_condition <> 'unknown'),
n AS (SELECT weather_condition, count(*) AS n, CAST(round(0.2 * count(*)) AS BIGINT) AS test FROM hist GROUP BY 1)
SELECT CAST(sum(n) - sum(test) AS BIGINT) AS n_train, CAST(sum(test) AS BIGINT) AS n_test,
  '{FULL_REFIT}' AS params_used, 'lambda,bogus' AS ignored_params FROM n"""
    q["retrain_job"] = with_(*base, SPLIT) + """SELECT 'completed' AS status, 'v=1' AS version,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  (SELECT string_agg(DISTINCT weather_condition, ',' ORDER BY weather_condition) FROM tt) AS active_classes FROM sp
UNION ALL SELECT 'failed', NULL, NULL, NULL, (SELECT string_agg(DISTINCT weather_condition, ',' ORDER BY weather_condition) FROM tt)"""
    q["score_batch"] = with_(*base) + """SELECT obs_id, CASE WHEN obs_id % 29 = 0 THEN 'missing_features' ELSE 'ok' END AS status,
  obs_id % 29 <> 0 AS predicted FROM tt"""
    cond = classify_sql("o.weather_description")
    q["score_fallback"] = with_(OBS, PLACES) + f"""SELECT obs_id,
  CASE WHEN c <> 'unknown' THEN 'api' WHEN obs_id % 50 = 7 THEN 'api (prediction fallback failed - missing features)'
       ELSE 'predicted (fallback)' END AS condition_source,
  CASE WHEN c <> 'unknown' THEN c END AS api_condition, c = 'unknown' AND obs_id % 50 = 7 AS still_unknown
FROM (SELECT o.obs_id, {cond} AS c FROM obs o JOIN places p ON p.City = o.City WHERE o.obs_id % 50 <> 0) x"""
    q["train_incremental"] = with_(*base) + """SELECT count(*) FILTER (WHERE d = last) AS n_day,
  string_agg(DISTINCT weather_condition, ',' ORDER BY weather_condition) FILTER (WHERE d < last) AS classes,
  TRUE AS scaler_kept, TRUE AS weights_moved FROM (SELECT *, CAST(datetime AS DATE) AS d, max(CAST(datetime AS DATE)) OVER () AS last FROM tt) x"""
    q["model_roundtrip"] = with_(*base, SPLIT) + "SELECT obs_id, TRUE AS same_prediction FROM sp WHERE split = 'test'"

    feat = FEAT.replace(" FROM clean)", " FROM clean JOIN places USING (City))")
    labels = [TARGET, *LABEL_LAG_COLS]
    dom = ("dom AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM ("
           + " UNION ".join(f"SELECT {c} AS label FROM ff" for c in labels) + ") u)")
    names = ["target_encoded_24h", *[f"{c}_encoded" for c in LABEL_LAG_COLS]]
    rows = ("fr AS (SELECT ff.*, " + ", ".join(f"d{i}.code AS {n}" for i, n in enumerate(names)) + " FROM ff "
            + " ".join(f"JOIN dom d{i} ON d{i}.label = ff.{c}" for i, c in enumerate(labels)) + ")")
    split = SPLIT.replace("PARTITION BY weather_condition", f"PARTITION BY {TARGET}").replace("FROM tt)", "FROM fr)")
    ctes = [OBS, CLEAN, PLACES, feat, FORECAST_CTE, dom, rows, split]
    stats = "st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{i}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1 ELSE stddev_pop({c}) END AS s_{i}"
        for i, c in enumerate(FORECAST_FEATURES)) + " FROM sp WHERE split = 'train')"
    q["forecast_matrix"] = (with_(*ctes, stats) + "SELECT obs_id, split, target_encoded_24h, "
                            + ", ".join(f"round(({c} - m_{i}) / s_{i}, 8) AS {c}" for i, c in enumerate(FORECAST_FEATURES))
                            + " FROM sp, st")
    q["forecast_balance"] = (with_(*ctes) + f"SELECT {TARGET}, (SELECT min(n) FROM (SELECT count(*) AS n FROM sp "
                             f"WHERE split = 'train' GROUP BY {TARGET}) c) AS n FROM sp WHERE split = 'train' GROUP BY 1")
    q["train_forecast"] = with_(*ctes) + f"SELECT label, support, TRUE AS same_by_sql FROM ({supports_sql('sp', TARGET)}) s"
    return q


def boosting_queries() -> dict[str, str]:
    """What is exact about boosting (the first round's splits and leaves), and what must hold of any
    model's saved predictions."""
    q = {}
    base = [OBS, CLEAN, PLACES, TRAIN_TABLE]
    # one split per class: the threshold between two values that parts the residuals [y = k] - 1/K best
    stumps = [f"({i}, '{f}', {f})" for i, f in enumerate(["humidity", "wind_speed"])]
    q["boost_first_round"] = with_(
        *base, "k AS (SELECT DISTINCT weather_condition AS label FROM tt)", "n AS (SELECT count(*) AS classes FROM k)",
        f"c AS (SELECT k.label, x.i, x.f, x.v, count(*) AS rows, count(*) FILTER (WHERE tt.weather_condition = k.label) AS own "
        f"FROM tt, LATERAL (VALUES {', '.join(stumps)}) x(i, f, v), k GROUP BY ALL)",
        "s AS (SELECT label, i, f, v, lead(v) OVER w AS nx, sum(rows) OVER w AS nl, sum(own) OVER w AS ol, "
        "sum(rows) OVER (PARTITION BY label, i) AS nt, sum(own) OVER (PARTITION BY label, i) AS ot "
        "FROM c WINDOW w AS (PARTITION BY label, i ORDER BY v))",
        "g AS (SELECT *, (ol - nl::DOUBLE / classes) AS gl, (ot - ol - (nt - nl)::DOUBLE / classes) AS gr, nt - nl AS nr, "
        "2 * (1::DOUBLE / classes) * (1 - 1::DOUBLE / classes) AS h FROM s, n WHERE nx IS NOT NULL)",
        "b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gl * gl / nl + gr * gr / nr DESC, i, v) AS rn FROM g)",
    ) + """SELECT label, f AS feature, round((v + nx) / 2, 8) AS threshold,
  round(0.1 * sign(gl) * greatest(abs(gl) - 0.5, 0) / (nl * h + 2), 8) AS value_left,
  round(0.1 * sign(gr) * greatest(abs(gr) - 0.5, 0) / (nr * h + 2), 8) AS value_right FROM b WHERE rn = 1"""
    supports = supports_sql("sp", "weather_condition")
    for name in ("boost_report", "forest_report", "train_report"):
        q[name] = with_(*base, SPLIT) + f"SELECT label, support, TRUE AS same_by_sql, TRUE AS beats_majority FROM ({supports}) s"
    q["job_report"] = with_(*base, SPLIT) + ("SELECT label, support, TRUE AS same_by_sql, TRUE AS beats_majority, "
                                             f"'completed' AS status, 'v=1' AS version FROM ({supports}) s")
    test = "SELECT count(*) AS n FROM sp WHERE split = 'test'"
    q["boost_losses"] = with_(*base, SPLIT) + f"SELECT r::INT AS round, n, TRUE AS same_alone, TRUE AS falls FROM range(1, 6) t(r), ({test}) x"
    q["log_loss_ovr"] = with_(*base, SPLIT) + f"SELECT n, TRUE AS same_by_sql, TRUE AS sums_to_one, TRUE AS beats_chance FROM ({test}) x"
    last = "(SELECT *, row_number() OVER (PARTITION BY datetime, province ORDER BY seq DESC) AS rn FROM (" + store_rows_sql(False) + ") r)"
    q["boost_update"] = f"""WITH hist AS (SELECT * FROM {last} x WHERE rn = 1 AND weather_condition <> 'unknown')
SELECT 'completed' AS status, count(*) AS n_rows, 'v=1' AS from_version, 'v=2' AS version, 3 AS rounds_before, 5 AS rounds_after,
  TRUE AS trees_kept, TRUE AS fits_the_day_better FROM hist WHERE CAST(datetime AS DATE) = (SELECT max(CAST(datetime AS DATE)) FROM {last} y)
UNION ALL SELECT 'no data', 0, 'v=2', NULL, 3, 5, TRUE, TRUE"""
    cls = classify_sql("weather_condition")
    known = " AND ".join(f"{m} IS NOT NULL" for m in METRICS)
    q["train_wide"] = with_(
        OBS, HOURLY, GRID, LONG, PLACES, f"w AS (SELECT {cls} AS y FROM lng JOIN places USING (City) WHERE {known} AND {cls} <> 'unknown')",
        "t AS (SELECT y, CAST(round(0.2 * count(*)) AS BIGINT) AS support FROM w GROUP BY y)",
    ) + "SELECT y, (SELECT count(*) FROM t) AS n_classes, 1.0::DOUBLE AS rates, support, TRUE AS beats_majority FROM t WHERE support > 0"
    return q


def stream_queries() -> dict[str, str]:
    """The store after ingesting every payload: per (hour, station) the last hourly entry by
    record (200 consecutive ids), then time, then obs_id."""
    q = {}
    q["ingest_stream"] = (with_(OBS, PLACES) + f"""SELECT datetime, province, humidity, latitude, longitude, pressure,
  temperature, weather_condition, wind_direction, wind_speed FROM (
  SELECT date_trunc('hour', o.datetime) AS datetime, o.City AS province,
    round(o.humidity, 8) AS humidity, round(p.Latitude, 8) AS latitude, round(p.Longitude, 8) AS longitude,
    round(o.pressure, 8) AS pressure, round(e.value / 10 + 273.15e0, 8) AS temperature,
    {classify_sql('o.weather_description')} AS weather_condition, round(o.wind_direction, 8) AS wind_direction,
    round(round(o.wind_speed * {KMPH}, 2), 8) AS wind_speed,
    row_number() OVER (PARTITION BY date_trunc('hour', o.datetime), o.City ORDER BY o.obs_id // 200 DESC, o.datetime DESC, o.obs_id DESC) AS rn
  FROM obs o JOIN events e ON e.event_id = o.obs_id JOIN places p ON p.City = o.City) x WHERE rn = 1""")
    q["ingest_ledger"] = with_(OBS, PLACES) + """SELECT run::INT AS run, 2 * payloads AS records, payloads AS malformed,
  CASE WHEN run = 1 THEN keys ELSE 0 END AS inserted, 0::BIGINT AS skipped, TRUE AS adds_up
FROM range(1, 3) t(run), (SELECT count(DISTINCT (City, CAST(datetime AS DATE), obs_id // 200)) AS payloads,
  count(DISTINCT (City, date_trunc('hour', datetime))) AS keys FROM obs JOIN places USING (City)) x"""
    q["score_stream"] = with_(OBS, CLEAN, PLACES, TRAIN_TABLE) + """SELECT obs_id,
  CASE WHEN obs_id % 29 = 0 THEN 'missing_features' ELSE 'ok' END AS status, TRUE AS same_as_batch, TRUE AS version_told FROM tt"""
    return q


def oracle_sql() -> dict[str, str]:
    q = {}
    q.update(stream_queries())
    q.update(obs_queries())
    q.update(source_queries())
    q.update(store_and_ml_queries())
    q.update(model_queries())
    q.update(boosting_queries())
    return q
