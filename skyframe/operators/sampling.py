"""Exact, reproducible stratified split and class undersampling.

Rows of a class are ranked by ``md5(key || '#' || seed)`` (ties by key); a class
keeps its first ``quota`` rows. ``sampleBy`` would only be approximate.

Scale: nothing sorts or shuffles the table. The first 4 hex digits of the hash form 65,536
buckets; one partial aggregate counts rows per (class, bucket), and running sums over that small
table tell in which bucket each class's quota ends. Only the rows of those buckets (one in
65,536 of a class) are ranked, which gives one threshold (hash, key) a class. The split is then
a comparison of each row with its class's threshold: a projection with a broadcast join of as
many rows as there are classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LABEL, SEED, TEST_FRACTION
from .metrics import MAX_CLASSES

BUCKET_HEX_DIGITS = 4


def hash_rank_key(key: str, seed: int = SEED):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")


def _within(df: DataFrame, label: str, key: str, seed: int, quota: Column) -> tuple[DataFrame, Column]:
    """``df`` with its class's threshold, and whether a row is among the first ``quota`` of its class
    (an expression over ``_n_label``, the class's rows, and ``_minority``, the fewest of any class).
    NULL labels are an error."""
    spark = df.sparkSession
    h = hash_rank_key(key, seed)
    hashed = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), h.alias("_h"))
    counts = hashed.groupBy("_label", _bucket(F.col("_h")).alias("_bkt")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (counts.withColumn("_upto", F.sum("_n").over(upto))
             .withColumn("_n_label", F.sum("_n").over(Window.partitionBy("_label")))
             # a min over one row per (class, bucket): a small table
             .withColumn("_minority", F.min("_n_label").over(Window.partitionBy()))
             .withColumn("_quota", quota.cast("long")))
    # the bucket in which the quota ends; a quota of 0 ends before all buckets
    ends = (sizes.where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))
                        | F.col("_label").isNull())
            .select("_label", "_bkt", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rest"))
            .limit(MAX_CLASSES + 1).collect())
    if any(r["_label"] is None for r in ends):
        raise ValueError(f"rows without a {label}")
    if len(ends) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels: not a class column")
    kinds = hashed.schema
    cut = F.broadcast(spark.createDataFrame(
        [tuple(r) for r in ends], f"_label {kinds['_label'].dataType.simpleString()}, _bkt int, _rest long"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key"))
    last = (hashed.withColumn("_bkt", _bucket(F.col("_h"))).join(cut, ["_label", "_bkt"])
            .withColumn("_rn", rank).where(F.col("_rn") == F.col("_rest")).select("_label", "_h", "_key").collect())
    limits = spark.createDataFrame([tuple(r) for r in last], f"_label {kinds['_label'].dataType.simpleString()}, _cut_h string, "
                                                             f"_cut_key {kinds['_key'].dataType.simpleString()}")
    joined = df.join(F.broadcast(limits), F.col(label) == F.col("_label"), "left")
    before = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    return joined, F.coalesce(before, F.lit(False))


_HELPERS = ["_label", "_cut_h", "_cut_key"]


def stratified_split(df: DataFrame, label: str = LABEL, key: str = "obs_id", test_fraction: float = TEST_FRACTION,
                     seed: int = SEED, split_col: str = "split") -> DataFrame:
    """Adds ``split`` ∈ {'train', 'test'}; each class sends exactly round(fraction · n_class)
    rows to test. Keys must be unique; a row without a label is an error."""
    joined, chosen = _within(df, label, key, seed, F.round(F.lit(float(test_fraction)) * F.col("_n_label")))
    return joined.withColumn(split_col, F.when(chosen, F.lit("test")).otherwise(F.lit("train"))).drop(*_HELPERS)


def undersample(df: DataFrame, label: str = LABEL, key: str = "obs_id", seed: int = SEED) -> DataFrame:
    """Every class reduced to the minority class size, without replacement."""
    joined, chosen = _within(df, label, key, seed, F.col("_minority"))
    return joined.where(chosen).drop(*_HELPERS)


def time_split(df: DataFrame, time_col: str, key: str, test_fraction: float = TEST_FRACTION,
               split_col: str = "split") -> DataFrame:
    """Chronological split: the latest round(fraction · n) rows (by time, then key) are 'test'.

    Avoids near-identical neighbours of overlapping series falling on both sides of a
    random split. Exact global positions come from sorted ranges (``windows.positions``),
    so no single task sorts the whole table or a day of it.
    """
    from .windows import positions
    n = df.count()  # a scalar from a distributed count
    cut = n - int(_round_half_up(test_fraction * n))
    pos = positions(df.withColumn("_all", F.lit(0)), ["_all"], time_col, tiebreak=[key])
    return (pos.withColumn(split_col, F.when(F.col("_pos") >= F.lit(cut), F.lit("test")).otherwise(F.lit("train")))
               .drop("_all", "_pos"))


def _round_half_up(x: float) -> float:
    """Half-up rounding of a non-negative number (as Spark's ``round``)."""
    import math
    return math.floor(x + 0.5)
