"""Wide → long reshaping, metric joins, place joins and the fetch plan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import CITY, DATETIME
from ..functions.scalars import month_ranges
from .cleaning import require_columns

# A dimension is broadcast only when its measured size is at most this.
MAX_BROADCAST_BYTES = 8 << 20


def measured_bytes(df: DataFrame) -> int:
    """Rows times width, strings measured: one aggregate over a dimension."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        fixed = f.dataType.typeName() not in ("string", "binary", "array", "map", "struct")
        width = width + (F.lit(8) if fixed else 16 + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
               max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join with a dimension; broadcast it only if it measures at most ``max_bytes``.

    Above the bound the plain join is kept and the planner picks a shuffle join (AQE
    can still demote it at runtime).
    """
    side = F.broadcast(small) if measured_bytes(small) <= max_bytes else small
    return big.join(side, on=on, how=how)


def common_columns(tables: Mapping[str, DataFrame], key: str = DATETIME) -> list[str]:
    """Columns (other than ``key``) present in every table, in first-table order."""
    names = list(tables)
    if not names:
        raise ValueError("no tables")
    shared = set(tables[names[0]].columns) - {key}
    for n in names[1:]:
        shared &= set(tables[n].columns)
    if not shared:
        raise ValueError("no common place columns across the wide tables")
    return [c for c in tables[names[0]].columns if c in shared]


def wide_to_long(df: DataFrame, value_name: str, places: Sequence[str] | None = None,
                 key: str = DATETIME, place_name: str = CITY) -> DataFrame:
    """(key, place₁ … placeₙ) → (key, place, value). Place names may contain spaces.

    A narrow transformation (Expand), no shuffle.
    """
    require_columns(df, [key])
    cols = list(places) if places is not None else [c for c in df.columns if c != key]
    require_columns(df, cols)
    return df.unpivot([key], cols, place_name, value_name)


def join_metrics(wide: Mapping[str, DataFrame], places: Sequence[str] | None = None, key: str = DATETIME,
                 place_name: str = CITY) -> DataFrame:
    """Wide metric tables → one long table (key, place, one column per metric).

    The tables are joined on the key while wide, each row carrying all places at once, and
    unpivoted once at the end: the joins shuffle one row per key instead of one per (key,
    place). Null keys never match. A key that repeats in a table repeats in the result, as it
    would after unpivoting first.
    """
    shared = list(places) if places is not None else common_columns(wide, key)
    frames = [df.where(F.col(key).isNotNull()).select(key, F.struct(*[F.col(f"`{p}`") for p in shared]).alias(name))
              for name, df in wide.items()]
    joined = reduce(lambda a, b: a.join(b, key, "inner"), frames)
    rows = F.array(*[F.struct(F.lit(p).alias(place_name), *[F.col(name).getField(p).alias(name) for name in wide])
                     for p in shared])
    return joined.select(key, F.inline(rows))


def join_places(df: DataFrame, places: DataFrame, on: str = CITY,
                cols: Sequence[str] = ("Latitude", "Longitude"), max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Attach place coordinates (inner join: places without coordinates drop out)."""
    dim = places.select(on, *cols)
    return join_small(df, dim, on, "inner", max_bytes)


def fetch_plan(places: DataFrame, start: str | _dt.date, end: str | _dt.date,
               name: str = "province_name") -> DataFrame:
    """Every place × every month range in [start, end] (one request row each).

    Generated per place row with ``explode`` over the month ranges — no join.
    """
    s = F.lit(_as_date(start))
    e = F.lit(_as_date(end))
    return (places.select("*", F.explode(month_ranges(s, e)).alias("r"))
                  .select(*places.columns, F.col("r.range_start").alias("range_start"),
                          F.col("r.range_end").alias("range_end")))


def explode_month_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per (input row, month range clipped to [start, end])."""
    return (df.select("*", F.explode(month_ranges(start, end)).alias("r"))
              .select(*df.columns, F.col("r.range_start").alias("range_start"),
                      F.col("r.range_end").alias("range_end")))


def _as_date(x) -> _dt.date:
    if isinstance(x, _dt.datetime):
        return x.date()
    if isinstance(x, _dt.date):
        return x
    return _dt.date.fromisoformat(str(x)[:10])
