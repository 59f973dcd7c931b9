"""File sources and sinks: wide metric CSVs, place dimensions, the observation store.

All scans are plain ``spark.read`` calls so that column pruning and filter
pushdown reach the files; numeric text is coerced with ``try_cast`` (bad → NULL).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..config import CITY, DATETIME, LABEL, PROVINCES_JSON_SCHEMA, STORE_COLS, STORE_SCHEMA, WIDE_FILES, WIDE_TABLES
from ..functions.scalars import parse_timestamp, to_double
from ..operators.cleaning import MissingColumnsError, require_columns
from . import snapshots


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_wide_csv(spark: SparkSession, path: str, value_type: str = "double",
                  key: str = DATETIME) -> DataFrame:
    """One wide CSV: header row, ``datetime`` then one column per place.

    Place columns are discovered from the header; values are coerced leniently.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, [key])
    cols = [F.col(f"`{key}`").alias("_k")]
    for c in raw.columns:
        if c == key:
            continue
        v = F.col(f"`{c}`")
        cols.append((to_double(v) if value_type == "double" else v).alias(c))
    out = raw.select(*cols).withColumn("_k", parse_timestamp("_k"))
    return out.withColumnRenamed("_k", key)


def read_wide_metrics(spark: SparkSession, directory: str, names: Sequence[str] = WIDE_TABLES) -> dict[str, DataFrame]:
    """The six wide metric tables by value column (files named by ``WIDE_FILES``); a missing
    file aborts."""
    d = directory.rstrip("/")
    return {n: read_wide_csv(spark, f"{d}/{WIDE_FILES[n]}.csv", "string" if n == LABEL else "double") for n in names}


def read_places_csv(spark: SparkSession, path: str, place: str = CITY,
                    cols: Sequence[str] = ("Latitude", "Longitude")) -> DataFrame:
    """Place attribute CSV; requires the place and coordinate columns, keeps only those."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, [place, *cols])
    return raw.select(F.col(place), *[to_double(c).alias(c) for c in cols])


def read_places_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Province list (a JSON array, or JSON lines with ``multi_line=False``).

    Coordinates are coerced leniently and rows without both are dropped; absent
    keys simply read as NULL, so a file lacking them yields an empty typed table.
    """
    raw = spark.read.schema(PROVINCES_JSON_SCHEMA).option("multiLine", multi_line).json(path)
    out = raw.select("province_name", to_double("latitude").alias("latitude"),
                     to_double("longitude").alias("longitude"))
    return out.dropna(subset=["latitude", "longitude"])


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    """History table kept as CSV: header row, the ten store columns in any order; numbers and
    timestamps are coerced leniently and rows without a readable timestamp are dropped."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, STORE_COLS)
    kinds = {f.name: f.dataType.typeName() for f in STORE_SCHEMA.fields}
    cols = [parse_timestamp(c).alias(c) if c == DATETIME else to_double(c).alias(c) if kinds[c] == "double" else F.col(c)
            for c in STORE_COLS]
    return raw.select(*cols).where(F.col(DATETIME).isNotNull())


# ---------------------------------------------------------------------------
# Observation store: Parquet partitioned by day
# ---------------------------------------------------------------------------

STORE_PARTITION = "day"


def with_day(df: DataFrame, time_col: str = DATETIME) -> DataFrame:
    return df.withColumn(STORE_PARTITION, F.to_date(F.col(time_col)))


def read_store(spark: SparkSession, path: str, days: Sequence | None = None,
               snapshot: snapshots.Snapshot | None = None) -> DataFrame:
    """Store scan with a fixed schema; an absent store is an empty typed table.

    The days come from the folders that the newest (or the given) snapshot names, and from the
    table's first write. ``days`` restricts the scan to those day partitions.
    """
    schema = T.StructType([*STORE_SCHEMA.fields, T.StructField(STORE_PARTITION, T.DateType())])
    snapshot = snapshots.latest(spark, path) if snapshot is None else snapshot
    wanted = None if days is None else {str(d) for d in days}
    parts = []
    if _has_days(spark, path):
        first = spark.read.schema(schema).parquet(path)
        replaced = [_dt.date.fromisoformat(d) for d in snapshot.days if wanted is None or d in wanted]
        parts.append(first.where(~F.col(STORE_PARTITION).isin(replaced)) if replaced else first)
    here = [f"{snapshots.folder_of(path, c)}/{STORE_PARTITION}={d}" for d, c in snapshot.days.items()
            if c and (wanted is None or d in wanted)]
    if here:
        named = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        parts.append(spark.read.schema(named).option("basePath", f"{path}/{snapshots.DATA}").parquet(*here).drop("commit"))
    if not parts:
        return spark.createDataFrame([], schema).select(*STORE_COLS)
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if days is not None:
        df = df.where(F.col(STORE_PARTITION).isin(list(days)))
    return df.select(*STORE_COLS)


def _has_days(spark: SparkSession, path: str) -> bool:
    """Whether the table's own folder holds day partitions."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath) and any(s.getPath().getName().startswith(f"{STORE_PARTITION}=") for s in fs.listStatus(jpath))


def write_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write store rows partitioned by day; with dynamic partition overwrite only the
    days present in ``df`` are replaced."""
    # Rebalanced by day: a day's rows meet in few files, and adaptive execution splits a day
    # that is larger than a partition should be.
    out = with_day(df.select(*STORE_COLS)).hint("rebalance", STORE_PARTITION)
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(STORE_PARTITION).parquet(path))


__all__ = ["MissingColumnsError", "read_wide_csv", "read_wide_metrics", "read_places_csv",
           "read_places_json", "read_history_csv", "read_store", "write_store", "with_day"]
