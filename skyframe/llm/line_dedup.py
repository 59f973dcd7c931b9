"""Line dedup: hashes of lines are range-partitioned and sorted by document and position,
first occurrences are streamed, and what comes back per document is a compressed bitmap.

A document is a ``doc_id``. Its lines are the text split at ``\\n`` (null or empty text: one
empty line). The key of a line is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends
and A-Z lower-cased. A key of at least ``min_chars`` code points found in at least
``min_docs`` documents loses its lines everywhere but in the largest ``doc_id`` holding it.

Only 128-bit line hashes, ids and positions are shuffled; texts meet their bitmaps once, in
a join on (doc_id, hash of text).

Hot keys. A histogram over the top bits of the hash (16, or enough for 64 prefixes a partition,
whatever the input) tells which hash ranges hold more than a quarter of an average partition. Lines in all
other ranges go through one range shuffle and a streaming window. Lines in the few heavy
ranges are aggregated first (partial counts collapse a hot key before the shuffle) and are
joined back with a join that adaptive execution can split.

Defined cases: rows that repeat a ``doc_id`` are the same document (it counts once, and as
the keeper it keeps the line in every row); a null ``doc_id`` is a document of its own that
sorts below all others; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP_SCHEMA = "doc_id long, text_hash long, dropped array<struct<start:int,length:int>>"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Stripped line, A-Z lower-cased (``lower`` would also change letters beyond ASCII)."""
    s = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line long enough to have a key."""
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
            .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(0x9E3779B1), "key").alias("h2")))


def _runs(pos: Column) -> Column:
    """Sorted positions as runs (start, length)."""
    starts = F.filter(pos, lambda x, i: (i == 0) | (F.get(pos, i - 1) != x - 1))
    ends = F.filter(pos, lambda x, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Run-length coded bitmaps of the dropped lines, one row per text that loses any:
    ``doc_id, text_hash, dropped`` (runs of line numbers). All other lines are kept."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    lines = materialise(line_records(docs, min_chars), "line-records")

    bits = max(16, n.bit_length() + 6)  # so that an average prefix holds less than a hot one by far
    prefix = F.shiftrightunsigned("h1", 64 - bits)
    hist = materialise(lines.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "line-histogram")
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    heavy = F.broadcast(hist.where(F.col("n") > max(1, total // (4 * n))).select("prefix"))  # fewer than 4 n rows

    w = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last(), "text_hash", "pos")
    whole = W.partitionBy("h1", "h2")
    streamed = (lines.join(heavy, prefix == heavy["prefix"], "left_anti")
                .repartitionByRange(n, "h1", "h2")
                .withColumn("keeper", F.first("doc_id").over(w))
                .withColumn("opens", (F.row_number().over(w) == 1)
                            | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(w)))
                .withColumn("n_docs", F.sum(F.col("opens").cast("int")).over(whole)))

    hot = lines.join(heavy, prefix == heavy["prefix"], "left_semi")
    frequent = materialise(
        hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs), "line-frequent")
    hot = hot.join(frequent, ["h1", "h2"])

    gone = (F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    drops = (streamed.where(gone).select("doc_id", "text_hash", "pos")
             .unionByName(hot.where(gone).select("doc_id", "text_hash", "pos")))
    per_text = drops.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    runs = F.get(F.transform(F.array("pos"), _runs), F.lit(0))  # bound once, used many times
    return materialise(per_text.select("doc_id", "text_hash", runs.alias("dropped")), "line-bitmaps")


def _kept_text(lines: Column, dropped: Column) -> Column:
    def segment(i: Column) -> Column:
        before, here = F.get(dropped, i - 1), F.get(dropped, i)
        start = F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["length"])
        end = F.coalesce(here["start"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), segment)), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text`` (null where the text is null and nothing is dropped),
    ``n_lines`` and ``n_dropped`` added; texts without a bitmap stay as they are."""
    right = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
                           F.col("dropped").alias("__dropped"))
    joined = docs.join(right, F.col("doc_id").eqNullSafe(F.col("__id"))
                       & (F.xxhash64("text") == F.col("__hash")), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(
        F.get(F.transform(F.array(lines), lambda x: _kept_text(x, F.col("__dropped"))), F.lit(0)))
    dropped = F.coalesce(F.aggregate("__dropped", F.lit(0).cast("long"),
                                     lambda a, r: a + r["length"]), F.lit(0).cast("long"))
    out = {"kept_text": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": dropped}
    return joined.select(*[docs[c] for c in docs.columns if c not in out],
                         *[v.alias(k) for k, v in out.items()])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Bitmaps built and applied in one go."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
