"""Ranked lexical search by presence masks.

Terms are the words of ``words`` (A-Z lower-cased). A document's score for an item sums
``weight * ((10^9 * tf) div (1000 * tf + 12 * m))`` over the item's terms, repeats included;
``weight`` falls with the documents that hold the term, ``m`` grows with the document's length
(``weights``, ``lengths``). All of it is integer arithmetic but for one logarithm.

Documents are scanned once per block of items for the terms of that block, and their postings
written. Counts of documents, terms and documents per term come from the postings of all rows.
Then each task takes its documents in blocks of ``block_docs``: every term has a bitmap of the
documents that hold it; for an item the bitmaps of its terms are transposed to one mask a
document, and equal masks form a group. A mask's largest possible score is the sum of its
terms' largest contributions in the block. Groups are evaluated in descending order of that
bound until it falls below the k-th score the task has found so far, which proves that no
document left can enter. The best k of each task and item meet in one ranking.

Nothing is collected but statistics of the terms of one block of items; a block holds items of
at most ``block_bytes`` bytes of text (at least one item), so what is sent to the tasks is
bounded. A word is looked up by its hash and then compared byte by byte.

Defined cases: null texts and texts without a term match nothing and do not count as documents;
every row of either table stands for itself, so repeated ids are ranked row by row; equal
scores rank by ascending doc_id, null first; an item that nothing matches has no rows; empty
tables give an empty result; very long texts are scanned in pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .words import same_bytes, scan

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item int, doc_id long, score long"


class Vocabulary:
    """The distinct terms of a block of items, looked up by hash and compared by bytes."""

    def __init__(self, texts: list[bytes | None]):
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        ids: dict[bytes, int] = {}
        hashes: list[int] = []
        for text in texts:
            bag: dict[int, int] = {}
            for w in scan([text], 0):
                for s, e, h in zip(w.starts.tolist(), w.ends.tolist(), w.hashes.tolist()):
                    term = w.low[s:e]
                    if term not in ids:
                        ids[term] = len(ids)
                        hashes.append(h)
                    bag[ids[term]] = bag.get(ids[term], 0) + 1
            self.items.append((np.array(list(bag), dtype=np.int64), np.array(list(bag.values()), dtype=np.int64)))
        self.size = len(ids)
        order = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
        self.hashes = np.array(hashes, dtype=np.uint64)[order]
        self.ids = order
        self.bytes = np.frombuffer(b"".join(ids), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in ids], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if ids else np.zeros(0, dtype=np.int64)

    def find(self, low: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that are terms, their term ids)."""
        if not self.size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = np.searchsorted(self.hashes, hashes)
        words, terms = [], []
        ties = 0
        while True:  # terms with equal hashes stand side by side; nearly always there is one
            spot = np.minimum(first + ties, self.size - 1)
            hit = np.flatnonzero((first + ties < self.size) & (self.hashes[spot] == hashes))
            if not len(hit):
                break
            term = self.ids[spot[hit]]
            same = ends[hit] - starts[hit] == self.lengths[term]
            hit, term = hit[same], term[same]
            same = same_bytes(np.frombuffer(low, dtype=np.uint8), starts[hit], self.bytes, self.offsets[term], self.lengths[term])
            words.append(hit[same])
            terms.append(term[same])
            ties += 1
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(words), np.concatenate(terms)


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, number of terms ``n`` (with repeats), and the vocabulary's terms in the text
    with their counts. Documents without a term are left out."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            pairs, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            parts = [(pairs, counts)]
            for w in scan(texts, 0):
                n += np.bincount(w.text, minlength=len(texts))
                word, term = known.find(w.low, w.starts, w.ends, w.hashes)
                parts.append(np.unique(w.text[word] * max(1, known.size) + term, return_counts=True))
            pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            counts = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(counts, where, np.concatenate([c for _, c in parts]))
            doc, term = np.divmod(pairs, max(1, known.size))
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, POSTINGS)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) per term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + ((25 * n * N) div L) per document."""
    return 75 + 25 * n * n_docs // n_terms


def masks(bitmaps: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """One bitmap of documents per term in, distinct masks of terms out: (masks as rows of bits,
    number of each document's mask)."""
    bits = np.unpackbits(bitmaps, axis=1, count=n_docs)
    group = np.zeros(n_docs, dtype=np.int64)
    for at in range(0, len(bits), 64):
        word = np.packbits(np.pad(bits[at:at + 64], ((0, -len(bits[at:at + 64]) % 64), (0, 0))), axis=0)
        word = np.unique(np.ascontiguousarray(word.T).view(np.uint64)[:, 0], return_inverse=True)[1]
        group = np.unique(group * (int(word.max()) + 1) + word, return_inverse=True)[1]
    first = np.zeros(int(group.max()) + 1, dtype=np.int64)
    first[group] = np.arange(n_docs)
    return bits[:, first].T, group


class Block:
    """Documents of one block: bitmaps and contributions per term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weight: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        order = np.lexsort((doc, term))
        self.doc, term, tf = doc[order], term[order], tf[order]
        m = lengths(n, n_docs, n_terms)
        self.gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc]))
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))
        self.most = np.maximum.reduceat(self.gain, self.starts) if len(term) else np.zeros(0, dtype=np.int64)
        present = np.zeros((len(self.terms), len(ids)), dtype=bool)
        present[np.repeat(np.arange(len(self.terms)), self.ends - self.starts), self.doc] = True
        self.bitmaps = np.packbits(present, axis=1)

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k, with their scores: all of score ``floor`` or
        more but those that k others of this block beat."""
        _, spot, here = np.intersect1d(self.terms, terms, assume_unique=True, return_indices=True)
        repeats = repeats[here]
        if not len(spot):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        mask, group = masks(self.bitmaps[spot], len(self.ids))
        bound = mask.astype(np.int64) @ (repeats * self.most[spot])
        by_group = np.argsort(group, kind="stable")
        size = np.bincount(group)
        begin = np.cumsum(size) - size
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        order = np.argsort(-bound, kind="stable")
        at, wanted = 0, 4 * k
        while at < len(order) and bound[order[at]] >= max(1, floor):
            # the next masks with at least ``wanted`` documents, as far as their bounds allow
            upto = at + 1 + int(np.searchsorted(np.cumsum(size[order[at:]]), wanted))
            some = order[at:min(upto, len(order))]
            some = some[bound[some] >= max(1, floor)]
            chosen = np.sort(np.concatenate([by_group[begin[g]:begin[g] + size[g]] for g in some.tolist()]))
            docs = np.concatenate([docs, chosen])
            scores = np.concatenate([scores, self._scores(chosen, spot, repeats)])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            at += len(some)
            wanted *= 2
        keep = scores >= max(1, floor)
        return docs[keep], scores[keep]

    def _scores(self, docs: np.ndarray, spot: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), dtype=np.int64)
        for s, times in zip(spot.tolist(), repeats.tolist()):
            held = self.doc[self.starts[s]:self.ends[s]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total += np.where(held[at] == docs, times * self.gain[self.starts[s] + at], 0)
        return total


def _blocks(batches: Iterator[pa.RecordBatch], block_docs: int, block_postings: int) -> Iterator[tuple]:
    held: list[tuple] = []
    docs = pairs = 0
    for batch in batches:
        ids = batch.column(0).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).array
        n = batch.column(1).to_numpy()
        terms, tfs = batch.column(2), batch.column(3)
        size = np.diff(terms.offsets.to_numpy())
        held.append((ids, n, docs + np.repeat(np.arange(len(n)), size), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
        docs += len(n)
        pairs += int(size.sum())
        if docs >= block_docs or pairs >= block_postings:
            yield _joined(held)
            held, docs, pairs = [], 0, 0
    if docs:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    ids, *arrays = zip(*held)
    return (pd.concat([pd.Series(i) for i in ids]).array, *[np.concatenate(a) for a in arrays])


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["score", "doc_id"], ascending=[False, True], na_position="first").head(k)


def task_best(posts: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int,
              n_terms: int, k: int, block_docs: int) -> DataFrame:
    """The best k documents of every task for each item (``item`` is its number)."""
    shared = posts.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best: dict[int, pd.DataFrame] = {}
        for arrays in _blocks(batches, block_docs, block_docs * 256):
            block = Block(*arrays, weight, n_docs, n_terms)
            for i, (terms, repeats) in enumerate(items):
                have = best.get(i)
                floor = int(have["score"].iloc[-1]) if have is not None and len(have) == k else 0
                docs, scores = block.best(terms, repeats, k, floor)
                if len(docs):
                    new = _top(pd.DataFrame({"doc_id": block.ids[docs], "score": scores}), k)
                    best[i] = new if have is None else _top(pd.concat([have, new]), k)
        for i, rows in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), i), pa.int32()), pa.array(rows["doc_id"], pa.int64()),
                 pa.array(rows["score"], pa.int64())], names=["item", "doc_id", "score"])

    return posts.mapInArrow(run, FOUND)


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[pd.DataFrame]:
    """Items by number in blocks of about ``block_bytes`` of text, one block at a time on the driver."""
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    numbered = materialise(items.select("item_id", F.col("text").cast("binary").alias("text"),
                                        F.monotonically_increasing_id().alias("row")), "search-items")
    for b in range(blocks):
        chosen = numbered.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        yield chosen.orderBy("row").toPandas()


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 16 << 20, block_docs: int = 8192) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    out = None
    for found in _item_blocks(items, block_bytes):
        vocabulary = Vocabulary([bytes(t) if t is not None else None for t in found["text"]])
        posts = materialise(postings(docs, vocabulary), "search-postings")
        size = posts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        counts = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()
        df = np.zeros(vocabulary.size, dtype=np.int64)
        df[counts["term"].to_numpy()] = counts["df"].to_numpy()
        best = task_best(posts, vocabulary.items, weights(size["docs"], df), size["docs"], size["terms"] or 1, k, block_docs)
        ids = spark.createDataFrame([(i, None if pd.isna(x) else int(x)) for i, x in enumerate(found["item_id"])],
                                    "item int, item_id long")
        w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
