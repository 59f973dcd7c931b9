"""N-gram Jaccard join by MinHash banding.

The n-grams of a text are its runs of ``n`` words (a text of fewer words, but not none, is
one n-gram). Two texts are linked if the Jaccard similarity of their n-gram sets is at least
``threshold``. Steps:

1. Texts with equal n-gram sets form a class (a grouped minimum over a 128-bit set hash);
   from here on each class is one text, so copies are never compared.
2. The class is MinHashed into bands of rows. ``band_plan`` takes as many rows as ``hashes``
   allow with a chance of at least ``recall`` that a pair at the threshold shares a band.
3. Band hashes are shuffled and counted; buckets of one class are dropped, and of buckets with
   exactly the same classes one is kept.
4. Classes meet in their buckets with their texts. A bucket of more than ``block`` classes, or
   of more than ``block_grams`` n-grams, is dealt into blocks, and every pair of blocks is a
   group of its own, so a group is bounded in texts and in bytes.
   A group compares full n-gram sets by counting common n-grams, and counts a pair in the
   least bucket it shares only. It returns each class's number of links, how many texts
   the linked classes hold, and a spanning forest of the links, never the pairs.
5. Links are summed, and the forests' edges joined into connected components.

Defined cases: texts without words (null, empty, signs only) link to nothing and are classes
of their own; repeated rows and ids are documents like others; null ids are allowed and never
name a class that has another id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, shuffle_partitions, slices
from .components import components
from .words import mix, scan


def band_plan(threshold: float, recall: float = 0.9999, hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): most rows whose bands, within ``hashes``, reach ``recall`` at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        agree = threshold ** rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-agree)) if agree < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


SCAN_BYTES = 1 << 18  # a quarter of what the scan takes at once: its arrays are the larger part of a task's memory


def gram_sets(texts: list[bytes | None], n: int) -> dict[int, np.ndarray]:
    """Sorted distinct n-gram hashes of every text that has words."""
    parts: dict[int, list[np.ndarray]] = {}
    for w in scan(texts, n - 1, SCAN_BYTES):
        gram, whole = w.gram(n), w.within(n)
        cut = np.flatnonzero(np.diff(w.text, prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            inside = gram[a:b][whole[a:b]]
            if not len(inside) and not int(w.index[a]):  # fewer words than n: all of them
                total = b - a
                for h in w.hashes[a:b].tolist():
                    total = (total * 0x9E3779B97F4A7C15 + h) % 2**64
                inside = mix(np.array([total], dtype=np.uint64))
            parts.setdefault(int(w.text[a]), []).append(inside)
    return {i: np.unique(np.concatenate(parts.pop(i))) for i in list(parts)}


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Band hashes; the band's number is part of each."""
        x = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
        low = np.min(np.stack([np.min(self.a * x[:, i:i + 1024] + self.b, axis=1)
                               for i in range(0, x.shape[1], 1024)]), axis=0).astype(np.uint64)
        total = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            total = total * np.uint64(0x9E3779B97F4A7C15) + low[j::self.rows]
        return mix(total)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_grams, set_a, set_b, bands) of every row; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in slices(batches, 2):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            size, a, b = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            keys: list = [None] * len(texts)
            for i, g in gram_sets(texts, n).items():
                with np.errstate(over="ignore"):
                    size[i] = len(g)
                    a[i] = np.sum(mix(g), dtype=np.uint64).astype(np.int64)
                    b[i] = np.sum(mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)
                keys[i] = minhash.keys(g).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(a), pa.array(b),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_grams", "set_a", "set_b", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        released(run), "doc_id long, text_hash long, n_grams long, set_a long, set_b long, bands array<long>")


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets`` (bounded by the block size)."""
    m = len(sets)
    value = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    common = times > 1  # values of one set only count for the diagonal
    place = np.cumsum(common) - 1
    take = common[column]
    owner, column = owner[take], place[column[take]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), dtype=np.float64)
    for begin in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        grid = np.zeros((m, width), dtype=np.float32)
        grid[owner[lo:hi], column[lo:hi] - begin] = 1
        out += grid @ grid.T
    return out


def _forest(linked: np.ndarray) -> list[int]:
    """For every row of a symmetric boolean matrix the row that its component grew from."""
    m = len(linked)
    root = [-1] * m
    for i in range(m):
        if root[i] < 0:
            root[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(linked[todo.pop()]).tolist():
                    if root[j] < 0:
                        root[j] = i
                        todo.append(j)
    return root


def compare_group(key: int, first: int, second: int, classes: list[int], blocks: list[int], held: list[int], keys: list[np.ndarray],
                  texts: list[bytes], n: int, threshold: float) -> list[tuple[int, int, int, int | None]]:
    """(class, links found here, texts ``held`` by the linked, root) of one group's classes that have a link."""
    found = gram_sets(texts, n)
    sets = [found[i] for i in range(len(texts))]
    common = shared_counts(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    union = size[:, None] + size[None, :] - common
    linked = common >= threshold * union - 1e-9
    block = np.array(blocks)
    if first != second:
        linked &= (block[:, None] == first) & (block[None, :] == second) | (block[:, None] == second) & (block[None, :] == first)
    np.fill_diagonal(linked, False)
    here = linked & (shared_counts([k[k < key] for k in keys]) == 0)
    links, others, root = here.sum(axis=1), here @ np.array(held, dtype=np.int64), _forest(linked)
    return [(c, int(links[i]), int(others[i]), classes[root[i]]) for i, c in enumerate(classes) if linked[i].any()]


def compare_groups(placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(class, links, texts, root) from classes placed in groups (key, first, second)."""
    parts = shuffle_partitions(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> list:
            if len(rows) < 2:
                return []
            return compare_group(*at, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows],
                                 [np.array(r[3], dtype=np.int64) for r in rows], [r[4] for r in rows], n, threshold)

        def emit(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["class", "links", "texts", "root"])

        for batch in slices(batches, 7):
            cols = [batch.column(i).to_pylist() for i in range(7)] + [batch.column(7).cast(pa.binary()).to_pylist()]
            out = []
            for key, first, second, c, b, held, keys, text in zip(*cols):
                if at != (key, first, second):
                    out += done()
                    at, rows = (key, first, second), []
                rows.append((c, b, held, keys, text))
            yield from emit(out)
        yield from emit(done())

    grouped = (placed.select("class", "held", "keys", "text", F.explode("buckets").alias("b"))
               .select("class", "held", "keys", "text", F.col("b.key").alias("key"), F.col("b.blocks").alias("blocks"))
               .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
                       "class", "block", "held", "keys", "text")
               .repartition(parts, "key", "first", "second").sortWithinPartitions("key", "first", "second"))
    return grouped.mapInArrow(released(run), "class long, links long, texts long, root long")


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999,
                    hashes: int = 192, block: int = 256, block_grams: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, group (null without words), class_id (least id
    of the connected component), n_links (other n-gram sets it is linked to), n_copies (rows
    with an equal set, itself included), n_texts (other texts it is linked to, those with an equal
    set included) and keeper (the row that stands for its component)."""
    bands, rows = band_plan(threshold, recall, hashes)
    sigs = materialise(signatures(docs, n, bands, rows), "jaccard-signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    worded = sigs.where(F.col("n_grams") > 0)
    held = worded.select("set_a", "set_b", "text_hash").distinct().groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("held"))
    classes = materialise(
        worded.groupBy("set_a", "set_b")
        .agg(F.min(rank).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"),
             F.first("n_grams").alias("n_grams")).join(held, ["set_a", "set_b"])
        .withColumn("class", F.monotonically_increasing_id()), "jaccard-classes")

    cell = classes.select("class", "n_grams", F.explode("bands").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("g") / block_grams)).cast("int")
    buckets = (cell.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"), F.bit_xor(F.xxhash64("class")).alias("x"),
                                       F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y"))
               .where(F.col("n") > 1)
               .groupBy("n", "g", "x", "y").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")))
    buckets = materialise(buckets, "jaccard-buckets")
    members = (cell.join(buckets, "key").groupBy("class")
               .agg(F.collect_list(F.struct("key", "blocks")).alias("buckets"))  # at most one per band
               .join(classes.select("class", "held", F.struct("rep.doc_id", "rep.text_hash").alias("row")), "class"))
    # rows that repeat a document are dropped where the join has brought them together
    placed = (docs.select(row_of().alias("row"), "text").join(members, "row").dropDuplicates(["row"])
              .select("class", "held", "buckets", F.transform("buckets", lambda b: b["key"]).alias("keys"), "text"))
    found = materialise(compare_groups(placed, n, threshold), "jaccard-links")

    links = found.groupBy("class").agg(F.sum("links").alias("n_links"), F.sum("texts").alias("texts"))
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    named = (classes.join(roots.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
             .select("set_a", "set_b", "rep", "n_copies", F.coalesce("root", "class").alias("group"),
                     F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     (F.coalesce("texts", F.lit(0).cast("long")) + F.col("held") - 1).alias("n_texts")))
    named = materialise(named, "jaccard-named")
    heads = named.groupBy("group").agg(F.min("rep").alias("head"))
    table = materialise(named.drop("rep").join(heads, "group"), "jaccard-groups")
    mine = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    joined = sigs.drop("bands").join(table, ["set_a", "set_b"], "left")
    wordless = F.col("n_grams") == 0
    return joined.select(
        "doc_id", "text_hash", F.when(~wordless, F.col("group")).alias("group"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(wordless, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(wordless, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(wordless, F.lit(0)).otherwise(F.col("n_texts")).cast("long").alias("n_texts"),
        (wordless | mine.eqNullSafe(F.col("head"))).alias("keeper"))


def row_of() -> Column:
    """What identifies a row: its id, null or not, and the hash of its text."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row left of each class; rows without words all stay."""
    found = (jaccard_classes(docs, **params).where("keeper")
             .select(F.struct("doc_id", "text_hash").alias("__row"), F.col("group").isNull().alias("__bare")).distinct())
    # one join brings the texts in; repeated rows of a keeper meet there and leave one, rows
    # without words keep a number of their own
    own = F.when(F.col("__bare"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    return (docs.withColumn("__row", row_of()).join(found, "__row").withColumn("__own", own)
            .dropDuplicates(["__row", "__own"]).select(*docs.columns))
