"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. The fingerprint of a window is the least hash of its k-grams (k = 5, or
all its words if fewer). The fingerprints of a text's windows are the winnowed set of that
text: any two texts that share a window share its fingerprint, so no shared span of ``n``
words is missed.

The documents are scanned for windows whose fingerprint the benchmark has, in blocks of at
most ``block`` fingerprints sent to every task (a benchmark that is larger takes several
scans, so what is sent has a fixed bound). Those candidates, with their words, are then joined
with the benchmark's windows on the words themselves, which extends each hit to the whole
window and makes the result exact. Hit windows are united per document.

Defined cases: texts that are null or have no words hold and hit nothing; items with a null
id mark words but are not listed; repeated items count once by id; repeated documents are
judged one by one; empty tables on either side give zeros; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released
from .words import Words, scan

HIT = pa.struct([("start", pa.int64()), ("length", pa.int32()), ("words", pa.string())])


def fingerprints(words: Words, length: int, k: int) -> np.ndarray:
    """Least k-gram hash of the window of ``length`` words that begins at each word."""
    k = min(k, length)
    gram = words.gram(k)
    n = max(0, len(words.hashes) - length + 1)
    least = gram[:n].copy()
    for j in range(1, length - k + 1):
        np.minimum(least, gram[j:j + n], out=least)
    return least


def item_windows(items: DataFrame, n: int, k: int) -> DataFrame:
    """(item_id, length, fingerprint, words) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            ids = batch.column(0).to_pylist()
            size = np.zeros(len(texts), dtype=np.int64)
            found = list(scan(texts, n - 1))
            for w in found:
                np.maximum.at(size, w.text, w.index + 1)
            rows = []
            for w in found:
                for length in np.unique(np.minimum(size[np.unique(w.text)], n)).tolist():
                    least, whole = fingerprints(w, length, k), w.within(length)
                    own = np.minimum(size[w.text[:len(whole)]], n) == length
                    rows += [(ids[w.text[i]], length, least[i].astype(np.int64).item(), w.phrase(i, length))
                             for i in np.flatnonzero(whole & own).tolist()]
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.string())],
                    names=["item_id", "length", "fingerprint", "words"])

    return (items.select("item_id", "text")
            .mapInArrow(released(run), "item_id long, length int, fingerprint long, words string"))


def candidates(docs: DataFrame, known: dict[int, np.ndarray], n: int, k: int) -> DataFrame:
    """``row, doc_id, text_hash, n_words, hits``: windows whose fingerprint is in ``known`` (by length)."""
    # a bit for the low 16 bits of each known fingerprint spares most of the look-ups
    bits = {}
    for length, keys in known.items():
        bits[length] = np.zeros(1 << 16, dtype=bool)
        bits[length][(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(w: Words, length: int) -> np.ndarray:
        least, keys = fingerprints(w, length, k), known[length]
        maybe = np.flatnonzero(bits[length][(least & np.uint64(0xFFFF)).astype(np.int64)] & w.within(length))
        spot = np.minimum(np.searchsorted(keys, least[maybe]), len(keys) - 1)
        return maybe[keys[spot] == least[maybe]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            size = np.zeros(len(texts), dtype=np.int64)
            hits: list[list] = [[] for _ in texts]
            for w in scan(texts, n - 1):
                np.maximum.at(size, w.text, w.index + 1)
                for length in known:
                    for i in matches(w, length).tolist():
                        hits[w.text[i]].append({"start": int(w.index[i]), "length": length, "words": w.phrase(i, length)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size), pa.array(hits, pa.list_(HIT))],
                names=["row", "doc_id", "text_hash", "n_words", "hits"])

    return (docs.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(released(run), "row long, doc_id long, text_hash long, n_words long, "
                             "hits array<struct<start:long,length:int,words:string>>"))


def _covered(spans):
    """Words covered by sorted spans (start, length)."""
    zero = F.lit(0).cast("long")

    def add(a, x):
        end = x["start"] + x["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"),
                        (a["n"] + F.greatest(zero, end - F.greatest(a["end"], x["start"]))).alias("n"))

    return F.aggregate(spans, F.struct(zero.alias("end"), zero.alias("n")), add)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, k: int = 5, share: int = 20,
                  block: int = 1 << 21) -> DataFrame:
    """``row, doc_id, text_hash, n_words, n_hit, item_ids`` (sorted as strings), ``contaminated``: some
    word is hit and the hit words are at least one in ``share``."""
    windows = materialise(item_windows(items, n, k).distinct(), "decon-windows")
    phrases = materialise(windows.select("words").distinct(), "decon-phrases")
    keys = windows.select("length", "fingerprint").distinct()
    blocks = max(1, -(-keys.count() // block))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if blocks > 1:  # several scans must give a row the same number
        numbered = materialise(numbered, "decon-documents")
    scans = []
    for b in range(blocks):
        known = keys.where(F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)) == b).toPandas()
        arrays = {int(length): np.sort(v.to_numpy(np.int64).view(np.uint64)) for length, v in known.groupby("length")["fingerprint"]}
        scans.append(materialise(candidates(numbered, arrays, n, k), "decon-candidates"))
    hits = scans[0]
    for other in scans[1:]:
        hits = hits.unionByName(other)
    hits = hits.select("row", F.inline("hits"))
    # what the joins read comes from files, so that a passage that very many documents share
    # can be split
    real = materialise(hits.join(phrases, "words", "left_semi"), "decon-hits")
    covered = (real.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
               .select("row", _covered(F.col("spans")).alias("n_hit")))
    listed = (real.select("row", "words").distinct()
              .join(windows.where(F.col("item_id").isNotNull()).select("words", "item_id"), "words")
              .groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (scans[0].select("row", "doc_id", "text_hash", "n_words").join(covered, "row", "left").join(listed, "row", "left")
            .select("row", "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated")))
