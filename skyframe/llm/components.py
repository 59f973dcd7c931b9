"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no neighbourhood is ever gathered in
one place. Minima are written before they are joined: both sides of each join then come from
files, and adaptive execution can split the partition of a node with very many edges. The
edge table never grows beyond its first size times a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of longs, any direction, repeats allowed. Returns (node, root): every
    node of an edge and the least node of its component."""
    e = materialise(edges.where(F.col("u") != F.col("v"))
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = _mark(e)
    while True:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least")
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("u"), F.col("m").alias("v")).distinct())
        large = materialise(large, "star-large")
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star-lowest")
        small = (large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        e = materialise(small, "components")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"),
              F.bit_xor(F.xxhash64("v", "u")).alias("b")).first()
    return tuple(r)
