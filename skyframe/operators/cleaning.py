"""Guards, cleaning filters and the one-pass cleaning audit."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CITY, DATETIME, LABEL, METRICS, STORE_COLS, UNKNOWN
from ..functions.conditions import classify_description


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail fast (no job runs) when required columns are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df


def default_required(df: DataFrame, label: str = LABEL) -> list[str]:
    loc = [c for c in ("Latitude", "Longitude", "latitude", "longitude") if c in df.columns]
    place = [c for c in (CITY, "province") if c in df.columns]
    return [*METRICS, *loc, label, *place, DATETIME]


def clean_observations(df: DataFrame, description: str | None = None, label: str = LABEL,
                       required: Sequence[str] | None = None) -> DataFrame:
    """Classify the description (if given) into ``label``, drop rows with a NULL/NaN in any
    required column, then drop the ``unknown`` class."""
    if description is not None:
        df = df.withColumn(label, classify_description(description))
    req = list(required) if required is not None else default_required(df, label)
    require_columns(df, req)
    return df.dropna(subset=req).where(F.col(label) != F.lit(UNKNOWN))


def cleaning_audit(df: DataFrame, description: str | None = None, label: str = LABEL,
                   required: Sequence[str] | None = None) -> DataFrame:
    """One row: rows_in, dropped_null, dropped_unknown, rows_kept — in a single aggregate pass."""
    if description is not None:
        df = df.withColumn(label, classify_description(description))
    req = list(required) if required is not None else default_required(df, label)
    require_columns(df, req)
    has_null = _nan_or_null(df, req)
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(has_null).alias("dropped_null"),
        F.count_if(~has_null & (F.col(label) == F.lit(UNKNOWN))).alias("dropped_unknown"),
        F.count_if(~has_null & (F.col(label) != F.lit(UNKNOWN))).alias("rows_kept"),
    )


def _nan_or_null(df: DataFrame, cols: Sequence[str]) -> Column:
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    expr = None
    for c in cols:
        cond = F.col(c).isNull()
        if c in floating:
            cond = cond | F.isnan(F.col(c))
        expr = cond if expr is None else (expr | cond)
    return expr


def day_slice(df: DataFrame, day: str | _dt.date, time_col: str = DATETIME,
              cols: Sequence[str] | None = STORE_COLS) -> DataFrame:
    """Rows whose timestamp falls on ``day`` ([00:00, 24:00)); Catalyst turns the date
    predicate into a half-open range that reaches the Parquet scan."""
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    out = df.where(F.to_date(F.col(time_col)) == F.lit(d))
    if cols is not None:
        out = out.select(*[c for c in cols if c in out.columns])
    return out


def previous_day(run_date: str | _dt.date) -> _dt.date:
    """The day before the run date (the daily job's window)."""
    d = run_date if isinstance(run_date, _dt.date) else _dt.date.fromisoformat(str(run_date))
    return d - _dt.timedelta(days=1)
