"""Row-offset time-series features: lead target, lags, trailing means, calendar parts.

Offsets count *rows* within a place ordered by time (a gap in hours stretches the
horizon), exactly like a grouped shift/rolling.

Scale design
------------
A plain ``Window.partitionBy(place)`` puts every row of a place into one task, so
parallelism is capped by the number of places and one hot place (a third of all
rows) becomes one giant sort. Instead the frame is cut into **blocks of at most
``block_rows`` consecutive rows per place**:

1. ``positions``: the rows are range-partitioned and sorted by (place, time) and
   written once. A range ends wherever the data say, also inside a place or a day, so no
   place, day or hour is a task of its own. The number a row gets in its sorted range,
   corrected by one small row per (place, range), is the exact 0-based row index ``_pos``
   of every row inside its place.
2. ``_blk = _pos div block_rows``. Each row is emitted into its own block and, when
   it lies within ``back`` rows of the block end (or ``ahead`` rows of its start),
   also as a *halo* copy into the neighbouring block. Window functions run over
   ``partitionBy(place, _blk).orderBy(_pos)``; only home rows are kept.

With ``block_rows >= back + ahead`` every home row sees all rows it needs, so the
result is identical to the per-place window, while each task handles at most
``block_rows + back + ahead`` rows whatever the skew. The halo costs
``(back + ahead) / block_rows`` extra rows (< 0.2 % at the default).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (CALENDAR_COLS, CITY, DATETIME, FORECAST_HORIZON, LABEL, LAG_STEPS, METRICS, WINDOW_SIZES,
                      lag_name, window_name)
from ..functions.scalars import calendar_columns
from ..session import scratch_path

DEFAULT_BLOCK_ROWS = 50_000

_HELPERS = ["_pos", "_blk", "_home", "_dup"]


def positions(df: DataFrame, partition_cols: Sequence[str], order_col: str,
              tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``_pos``: the 0-based index of each row within its partition, ordered by
    ``(order_col, *tiebreak)``. Rows with a null partition form one of their own; null order
    values come first.

    One scan of ``df``: its sorted ranges are written under the shared checkpoint folder,
    where the counts and the result read them.
    """
    parts, order = list(partition_cols), [order_col, *tiebreak]
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    # the id is (number of the range << 33) + place in it
    ranged = (df.repartitionByRange(n, *parts, *order).sortWithinPartitions(*parts, *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(*parts, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*parts).orderBy("_range")  # a row per (place, range)
    shifts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(parts)], F.col("_range").alias("_r"),
                           (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(parts):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (ranged.join(shifts, same).withColumn("_pos", F.col("_at") + F.col("_shift"))
            .select(*df.columns, "_pos"))


def blocked_frame(df: DataFrame, partition_cols: Sequence[str], order_col: str, back: int, ahead: int,
                  tiebreak: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS,
                  strategy: str = "blocked") -> tuple[DataFrame, Window]:
    """Prepare ``df`` for row-offset window functions reaching ``back`` rows behind
    and ``ahead`` rows ahead. Returns the (halo-extended) frame and the window spec;
    apply window functions, then call :func:`finish_frame`.

    ``strategy="partition"`` is the textbook per-place window (used to cross-check).
    """
    parts = list(partition_cols)
    order = [F.col(order_col), *[F.col(c) for c in tiebreak]]
    # an order over all columns leaves only identical rows equal, and those can change places
    total = set(df.columns) <= {*parts, order_col, *tiebreak}

    def repeats(w: Window) -> Column:
        return F.lit(False) if total else _repeats(order, w)

    if strategy == "partition":
        w = Window.partitionBy(*parts).orderBy(*order)
        return df.withColumn("_home", F.lit(True)).withColumn("_dup", repeats(w)), w
    if strategy != "blocked":
        raise ValueError(f"unknown strategy {strategy!r}")
    if block_rows < back + ahead or block_rows < 1:
        raise ValueError("block_rows must be at least back + ahead")
    pos = positions(df, parts, order_col, tiebreak)
    blk = F.floor(F.col("_pos") / F.lit(block_rows))
    off = F.col("_pos") - blk * F.lit(block_rows)
    home = F.struct(blk.alias("b"), F.lit(True).alias("h"))
    to_next = F.when(off >= F.lit(block_rows - back), F.struct((blk + 1).alias("b"), F.lit(False).alias("h")))
    to_prev = F.when((off < F.lit(ahead)) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("h")))
    targets = F.filter(F.array(home, to_next, to_prev), lambda x: x.isNotNull())
    framed = (pos.withColumn("_t", F.explode(targets))
                 .withColumn("_blk", F.col("_t.b")).withColumn("_home", F.col("_t.h")).drop("_t"))
    w = Window.partitionBy(*parts, "_blk").orderBy("_pos")
    return framed.withColumn("_dup", repeats(w)), w


def _repeats(order: Sequence[Column], w: Window) -> Column:
    """Whether the row before it has the same place in the order."""
    return F.lag(F.struct(*order)).over(w).eqNullSafe(F.struct(*order))


def total_order(df: DataFrame, key: str, place: str = CITY, time_col: str = DATETIME) -> list[str]:
    """Tiebreak for rows of a place that share their time: the key, then all other columns."""
    return [key, *[c for c in df.columns if c not in (key, place, time_col)]]


def finish_frame(df: DataFrame) -> DataFrame:
    """Keep home rows and drop helper columns. An order that leaves rows equal which may differ
    has no defined result and is an error."""
    unique = F.when(F.col("_dup"), F.raise_error(F.lit("rows of a place are equal in order; pass tiebreak"))
                    .cast("boolean")).otherwise(F.lit(True))
    out = df.where(F.col("_home") & unique)
    return out.drop(*[c for c in _HELPERS if c in out.columns])


# ---------------------------------------------------------------------------
# Feature expressions over a window spec
# ---------------------------------------------------------------------------

def target_expr(w: Window, label: str = LABEL, horizon: int = FORECAST_HORIZON) -> Column:
    return F.lead(F.col(label), horizon).over(w)


def lag_exprs(w: Window, cols: Sequence[str], steps: Sequence[int]) -> dict[str, Column]:
    return {lag_name(c, k): F.lag(F.col(c), k).over(w) for c in cols for k in steps}


def min_periods(window: int) -> int:
    return max(1, int(window * 0.5))


def rolling_mean_exprs(w: Window, cols: Sequence[str], sizes: Sequence[int]) -> dict[str, Column]:
    """Mean of the previous ``size`` rows (current row excluded), NULL when fewer than
    ``max(1, size // 2)`` non-null values are in the frame."""
    out = {}
    for c in cols:
        for size in sizes:
            frame = w.rowsBetween(-size, -1)
            out[window_name(c, size)] = F.when(F.count(F.col(c)).over(frame) >= F.lit(min_periods(size)),
                                               F.avg(F.col(c)).over(frame))
    return out


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------

def add_target(df: DataFrame, label: str = LABEL, horizon: int = FORECAST_HORIZON, place: str = CITY,
               time_col: str = DATETIME, drop_missing: bool = True, **frame_opts) -> DataFrame:
    """``target_<label>_<h>h`` = the label ``horizon`` rows later in the same place."""
    framed, w = blocked_frame(df, [place], time_col, back=0, ahead=horizon, **frame_opts)
    name = f"target_{label}_{horizon}h"
    out = finish_frame(framed.withColumn(name, target_expr(w, label, horizon)))
    return out.where(F.col(name).isNotNull()) if drop_missing else out


def add_lags(df: DataFrame, cols: Sequence[str] = (*METRICS, LABEL), steps: Sequence[int] = LAG_STEPS,
             place: str = CITY, time_col: str = DATETIME, **frame_opts) -> DataFrame:
    """``<col>_lag_<k>h`` = value ``k`` rows earlier in the same place; all in one Window node."""
    framed, w = blocked_frame(df, [place], time_col, back=max(steps), ahead=0, **frame_opts)
    exprs = lag_exprs(w, cols, steps)
    return finish_frame(framed.select("*", *[e.alias(n) for n, e in exprs.items()]))


def add_rolling_means(df: DataFrame, cols: Sequence[str] = METRICS, sizes: Sequence[int] = WINDOW_SIZES,
                      place: str = CITY, time_col: str = DATETIME, **frame_opts) -> DataFrame:
    framed, w = blocked_frame(df, [place], time_col, back=max(sizes), ahead=0, **frame_opts)
    exprs = rolling_mean_exprs(w, cols, sizes)
    return finish_frame(framed.select("*", *[e.alias(n) for n, e in exprs.items()]))


# ---------------------------------------------------------------------------
# The same features by time instead of by row
# ---------------------------------------------------------------------------

HOUR = 3_600_000_000  # microseconds


def _micros(time_col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{time_col}`)")


def exact_time_features(df: DataFrame, place: str = CITY, time_col: str = DATETIME, label: str = LABEL,
                        cols: Sequence[str] = (*METRICS, LABEL), horizon: int = FORECAST_HORIZON,
                        lag_steps: Sequence[int] = LAG_STEPS, window_sizes: Sequence[int] = WINDOW_SIZES,
                        block_hours: int = 720) -> DataFrame:
    """Target, lags and trailing means counted in hours: a lag of k is the value exactly k hours
    before and NULL if there is none, a mean takes the rows of the hours before (the current
    time excluded; NULL with fewer values than half the window has hours).

    Places are cut into blocks of ``block_hours``; a row also goes, as a copy, to the next block if that
    block's rows may look back at it, and to the one before if they may look ahead at it. The
    blocks are windows with range frames over the time, so a place is many tasks' work. Rows
    without a time have no features and are left out; two rows of a place with one time are an error.
    """
    back, ahead = max([*lag_steps, *window_sizes]) * HOUR, horizon * HOUR
    block = block_hours * HOUR
    if block < max(back, ahead):
        raise ValueError("a block must be as long as the longest lag, window and horizon")
    timed = df.where(F.col(time_col).isNotNull()).withColumn("_pos", _micros(time_col))
    blk = F.floor(F.col("_pos") / F.lit(block))
    off = F.col("_pos") - blk * F.lit(block)
    home = F.struct(blk.alias("b"), F.lit(True).alias("h"))
    to_next = F.when(off >= F.lit(block - back), F.struct((blk + 1).alias("b"), F.lit(False).alias("h")))
    to_prev = F.when(off <= F.lit(ahead), F.struct((blk - 1).alias("b"), F.lit(False).alias("h")))
    framed = (timed.withColumn("_t", F.explode(F.filter(F.array(home, to_next, to_prev), lambda x: x.isNotNull())))
              .withColumn("_blk", F.col("_t.b")).withColumn("_home", F.col("_t.h")).drop("_t"))
    w = Window.partitionBy(place, "_blk").orderBy("_pos")

    def at(c: str, hours: int) -> Column:
        return F.first(c).over(w.rangeBetween(hours * HOUR, hours * HOUR))

    means = {}
    for c in [c for c in cols if c != label]:
        for size in window_sizes:
            frame = w.rangeBetween(-size * HOUR, -1)
            means[window_name(c, size)] = F.when(F.count(F.col(c)).over(frame) >= F.lit(min_periods(size)), F.avg(F.col(c)).over(frame))
    out = framed.select("*", (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) > 1).alias("_dup"),
                        at(label, horizon).alias(f"target_{label}_{horizon}h"),
                        *[at(c, -k).alias(lag_name(c, k)) for c in cols for k in lag_steps],
                        *[e.alias(n) for n, e in means.items()])
    return finish_frame(out)


def add_calendar(df: DataFrame, time_col: str = DATETIME) -> DataFrame:
    cal = calendar_columns(time_col)
    return df.select("*", *[cal[n].alias(n) for n in CALENDAR_COLS])


def forecast_features(df: DataFrame, place: str = CITY, time_col: str = DATETIME, label: str = LABEL,
                      horizon: int = FORECAST_HORIZON, lag_steps: Sequence[int] = LAG_STEPS,
                      window_sizes: Sequence[int] = WINDOW_SIZES, **frame_opts) -> DataFrame:
    """Full T+h feature frame from *cleaned* observations (labels and metrics non-null).

    target (lead h) → lags of metrics and label → trailing means → calendar parts,
    then rows lacking the target or any lag/mean are dropped. Everything is one
    pass over one window spec, so the plan has a single Window operator.

    One pass equals the reference's drop-then-lag order: with non-null labels the
    target is missing exactly for the last ``h`` rows of a place, and lags only
    look backwards, so dropping those rows first changes no surviving lag.
    """
    back = max(max(lag_steps), max(window_sizes))
    framed, w = blocked_frame(df, [place], time_col, back=back, ahead=horizon, **frame_opts)
    target = f"target_{label}_{horizon}h"
    lags = lag_exprs(w, [*METRICS, label], lag_steps)
    means = rolling_mean_exprs(w, METRICS, window_sizes)
    cal = calendar_columns(time_col)
    out = framed.select("*", target_expr(w, label, horizon).alias(target),
                        *[e.alias(n) for n, e in lags.items()],
                        *[e.alias(n) for n, e in means.items()],
                        *[cal[n].alias(n) for n in CALENDAR_COLS])
    out = finish_frame(out)
    required = [target, *lags.keys(), *means.keys()]
    return out.dropna(subset=required)
