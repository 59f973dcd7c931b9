"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash into buckets of about ``bucket_bytes``, small
enough to be shuffled in memory. Pass 2 shuffles each bucket with Fisher-Yates (Spark's
``shuffle``) and writes it. Laid end to end, the buckets are one random permutation of the
input; shard ``s`` of ``k`` is its ``s``-th slice, so shard sizes differ by at most one row
(law ``rows``). A record's place is the offset of its bucket (a running sum over one small
row per bucket) plus its index there.

The hash takes the row's number in its scan besides its id and text, so that repeated rows,
however many, scatter as evenly as distinct ones. The size of a text is its UTF-8 bytes plus
one (null: one).

Defined cases: null ids and texts are records like others; repeated rows each get their own
slot; an empty table gives an empty result; other columns travel along unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions


BROADCAST_ROWS = 1 << 20  # bucket offsets sent to every task: 32 MB at most


def shuffled_buckets(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Written table (bucket, index, record), every bucket in Fisher-Yates order, and the
    number of buckets."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total = docs.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("t")).first()["t"]
    # a task shuffles some buckets, not more than about four of full size
    n = max(shuffle_partitions(spark), math.ceil(total / (4 * bucket_bytes)))
    buckets = max(8 * n, math.ceil(total / bucket_bytes))
    spot = F.xxhash64(F.lit(seed), "doc_id", "text", F.col("__row"))
    scattered = (docs.select(F.struct(*docs.columns).alias("record"), "doc_id", "text",
                             F.monotonically_increasing_id().alias("__row"))
                 .select("record", spot.alias("spot"))
                 .select("record", "spot", F.pmod(F.xxhash64(F.lit(seed + 1), "spot"), F.lit(buckets)).alias("bucket"))
                 .repartition(n, "bucket")
                 .sortWithinPartitions("bucket", "spot"))
    mixed = (scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"))
             .select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("index", "record")))
    return materialise(mixed, "shard-buckets"), buckets


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 20240229,
          bucket_bytes: int = 16 << 20) -> DataFrame:
    """``record`` (all input columns), ``shard`` (0 to n_shards - 1) and ``slot`` (from 0)."""
    mixed, buckets = shuffled_buckets(docs, seed, bucket_bytes)
    counts = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("bucket")
    offsets = counts.select("bucket", (F.sum("n").over(w) - F.col("n")).alias("before"),
                            F.sum("n").over(W.partitionBy()).alias("total"))
    if buckets <= BROADCAST_ROWS:  # else a join by bucket shuffles the records once more
        offsets = F.broadcast(offsets)
    place = F.col("before") + F.col("index")
    # integer arithmetic: shard s holds the places from ceil(s * total / k) on
    return (mixed.join(offsets, "bucket")
            .withColumn("place", place)
            .withColumn("shard", F.expr(f"(place * {n_shards}) div total").cast("int"))
            .withColumn("slot", F.expr(f"place - ((shard * total + {n_shards - 1}) div {n_shards})"))
            .select("record", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    (sharded.select("record.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
     .repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
     .write.partitionBy("__shard").parquet(path))
