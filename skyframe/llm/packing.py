"""Packing by concatenate and cut.

Pass 1 tokenizes every text, ends it with ``end_id`` and writes its ids once, together with
the number of ids before it in its partition. The totals of the partitions (one small row
each) are summed up to give every partition its global offset. Pass 2 knows every document's
place in the endless sequence and cuts it at the multiples of ``length``: a document that
crosses a border gives a piece on either side of it. All sequences but the last are full.

Tokens. The tokenizer drops white space and splits text into runs of letters, single digits
and runs of other signs before merging, so texts are cut at those borders (ASCII only, and
not after an apostrophe, which may open a contraction), each distinct unit is encoded once by
the ``tokenizers`` library and the ids are put together by table look-up. Texts with ``<|``,
which may hold a special token, and texts with control signs that count as white space for
some and not for others are encoded whole. Such a table needs a tokenizer with these rules;
pass ``by_unit=False`` for others.

Defined cases: null and empty texts consist of ``end_id`` alone; repeated rows and ids are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, released
from .words import CHUNK, hash_spans, same_bytes

SPACE, LETTER, DIGIT, SIGN, QUOTE, OTHER = range(6)
TABLE_LIMIT = 1 << 20  # distinct units a worker keeps; beyond, it starts anew


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = (SPACE if c in " \t\n\r" else LETTER if c.isalpha() else DIGIT if c.isdigit()
                  else QUOTE if c == "'" else SIGN)
    return out


def _borders() -> np.ndarray:
    """Whether a unit ends between two neighbouring bytes of these classes."""
    out = np.zeros((6, 6), dtype=bool)
    for a in (LETTER, DIGIT, SIGN):
        for b in (LETTER, DIGIT, SIGN, QUOTE):
            out[a, b] = a != b and not (a == SIGN and b == QUOTE)
    out[DIGIT, DIGIT] = True
    out[SPACE, 1:] = True
    return out


CLASS, BORDER = _classes(), _borders()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = tuple(bytes([b]) for b in (11, 12, 28, 29, 30, 31))


class UnitEncoder:
    """ids of texts by a growing table from unit to ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted hashes of units
        self.at = np.zeros(0, dtype=np.int64)  # their places in the next four
        self.offset = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")
        self.name_offset = np.zeros(1, dtype=np.int64)
        self.names = np.zeros(0, dtype=np.uint8)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the units one after the other, and how many each has."""
        if all(map(str.isalpha, units)):  # each is one word, so its last id is one that ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(units):
                return ids, np.diff(ends, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], dtype="<u4"), np.array([len(ids) for ids in each])

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        words = [u.decode("utf-8", "replace") for u in units]
        order = sorted(range(len(words)), key=lambda i: not words[i].isalpha())
        alpha = sum(map(str.isalpha, words))
        found = [self._ids([words[i] for i in group])
                 for group in [*(order[i:min(i + 1000, alpha)] for i in range(0, alpha, 1000)), order[alpha:]] if group]
        ends = self.offset[-1] + np.cumsum(np.concatenate([size for _, size in found]))
        at = np.arange(len(order)) + len(self.offset) - 1
        self.offset = np.concatenate([self.offset, ends])
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in found]])
        names = [units[i] for i in order]
        self.name_offset = np.concatenate([self.name_offset, self.name_offset[-1] + np.cumsum([len(u) for u in names])])
        self.names = np.concatenate([self.names, np.frombuffer(b"".join(names), dtype=np.uint8)])
        hashes = hashes[order]
        rank = np.argsort(hashes)
        spot = np.searchsorted(self.keys, hashes[rank])
        self.keys, self.at = np.insert(self.keys, spot, hashes[rank]), np.insert(self.at, spot, at[rank])

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of each text; none of them needs to be encoded whole. Units are looked up by hash and
        compared by bytes; a text with one that only shares its hash is encoded whole after all."""
        low = b" ".join(texts).translate(_LOWER)
        kind = CLASS[np.frombuffer(low, dtype=np.uint8)]
        before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
        starts = np.flatnonzero(BORDER.ravel()[before * 6 + kind])
        after = np.concatenate([kind[1:], [np.uint8(SPACE)]])
        ends = np.flatnonzero((kind != SPACE) & ((after == SPACE) | BORDER.ravel()[kind * 6 + after])) + 1
        if not len(starts):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        hashes, first, back = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != hashes[inside]
        if new.any():
            if len(self.keys) + new.sum() > TABLE_LIMIT:
                self.clear()
                new[:] = True
            at = first[new]
            self._learn([low[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], hashes[new])
            spot = np.searchsorted(self.keys, hashes)
        unit = self.at[spot][back]
        size = self.offset[unit + 1] - self.offset[unit]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.offset[unit] - (stop - size), size) + np.arange(stop[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], stop])[np.searchsorted(starts, text_ends)]
        out = np.split(ids, cuts[:-1])
        for i in np.unique(np.searchsorted(text_ends, starts[~self._known(low, starts, ends, unit)], side="right")).tolist():
            out[i] = self.whole(texts[i])
        return out

    def _known(self, low: bytes, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether each unit found in ``low`` is, byte by byte, the one of the table."""
        same = ends - starts == self.name_offset[unit + 1] - self.name_offset[unit]
        at = np.flatnonzero(same)
        same[at] = same_bytes(np.frombuffer(low, dtype=np.uint8), starts[at], self.names, self.name_offset[unit[at]], (ends - starts)[at])
        return same

    def encode(self, texts: list[bytes | None], by_unit: bool) -> Iterator[np.ndarray]:
        group: list[bytes] = []
        size = 0
        for t in texts:
            t = t or b""
            if not by_unit or b"<|" in t or any(c in t for c in _ODD):
                yield from self.many(group) if group else ()
                yield self.whole(t)
                group, size = [], 0
                continue
            if len(t) > CHUNK:
                yield from self.many(group) if group else ()
                yield np.concatenate([ids for part in _cut(t) for ids in self.many([part])])
                group, size = [], 0
                continue
            group.append(t)
            size += len(t)
            if size > CHUNK:
                yield from self.many(group)
                group, size = [], 0
        yield from self.many(group) if group else ()


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end before a space."""
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + CHUNK)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end


_encoders: dict[str, UnitEncoder] = {}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, by_unit: bool = True) -> DataFrame:
    """Written table (doc_id, part, before, doc_tokens, ids): ``ids`` little-endian unsigned
    32-bit with ``end_id`` last, ``before`` the ids before it in partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, UnitEncoder(tokenizer))
        part, before, last = TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            done = 0
            for chunk in _slices(texts):
                ids = [x.tobytes() + last for x in encoder.encode(texts[chunk], by_unit)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                stop = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(ids)), pa.array([part] * len(ids), pa.int32()),
                     pa.array(stop - n), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"])
                before, done = int(stop[-1]), done + len(ids)

    return materialise(
        docs.select("doc_id", "text").mapInArrow(
            released(run), "doc_id long, part int, before long, doc_tokens long, ids binary"),
        "packing-ids", compression="zstd")


def _slices(texts: list[bytes | None]) -> Iterator[slice]:
    """Consecutive slices of about four CHUNKs of text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > 4 * CHUNK:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, by_unit: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    ids = tokenized(docs, tokenizer, end_id, by_unit)
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    w = W.orderBy("part")  # one row per partition of the scan
    bases = totals.select("part", (F.sum("n").over(w) - F.col("n")).alias("base"))
    placed = (ids.join(F.broadcast(bases), "part")  # bounded by the number of partitions
              .withColumn("place", F.col("base") + F.col("before")))
    size = F.lit(length).cast("long")
    first = F.expr(f"place div {length}")
    last = F.expr(f"(place + doc_tokens - 1) div {length}")

    def piece(s):
        start = F.greatest(s * size - F.col("place"), F.lit(0).cast("long"))
        stop = F.least((s + 1) * size - F.col("place"), F.col("doc_tokens"))
        return F.struct(start.alias("start"), (stop - start).alias("length"),
                        F.substring("ids", (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
                        s.alias("sequence_id"), (F.col("place") + start - s * size).alias("offset"))

    return (placed.select("doc_id", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"))


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, ids (array), n_tokens; the last one padded with pad_id."""
    ints = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.conv(F.concat(
        *[F.hex(F.substring("ids", (i * 4 + b).cast("int"), F.lit(1))) for b in (4, 3, 2, 1)]), 16, 10).cast("long"))
    rows = pieces.select("sequence_id", F.struct("offset", ints.alias("ids")).alias("piece"), "length")
    full = rows.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"),
        F.sum("length").alias("n_tokens"))
    return full.select("sequence_id", F.concat("ids", F.array_repeat(
        F.lit(pad_id).cast("long"), (F.lit(length) - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens")
