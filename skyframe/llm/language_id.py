"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of order 0 to 3. A symbol seen n times in a context
with T symbols of q kinds has probability n / (T + q) there; an unseen one costs the escape
q / (T + q) and is coded in the next shorter context, last in a uniform one over 256 bytes
(method C, no exclusions). Statistics are frozen after training, so the code length of a text
in a language is an exact sum over its bytes. The language with the shortest code wins; its
score is its share of 2^-length over all languages.

Training counts runs of four bytes per language with a shuffle; the counts of shorter runs
follow from them. It takes at most about ``sample_docs`` rows a language, chosen by hash of
the row; the model goes to every task. Scoring looks up each four-byte run once for all
languages. ASCII letters are lower-cased first.

Defined cases: a text that is null or has no letter gets ``und`` with score 0, as does every
text if there is nothing to learn from; training rows with a null language or text are left
out; ties go to the language that sorts first; repeated rows and null ids are rows like
others; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, slices

ORDER = 3
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 18  # bytes scored at once
MAX_LANGUAGES = 1000
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    """Whether a sign of the text is a letter (Unicode category L; numbers such as Ⅷ or ½ are none)."""
    if not text:
        return False
    return bool(ASCII_LETTER.search(text)) or any(
        unicodedata.category(c).startswith("L") for c in set(text.decode("utf-8", "replace")))


def _runs(padded: bytes) -> np.ndarray:
    """The four bytes that end at each byte from the fourth on, as one number."""
    b = np.frombuffer(padded, dtype=np.uint8).astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def count_runs(training: DataFrame, sample_docs: int) -> pd.DataFrame:
    """(lang, run, n) over a bounded sample of ``training`` (text, lang)."""
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values; it is no language column")
    if not sizes:
        return pd.DataFrame({"lang": [], "run": [], "n": []})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["n"]))])
    draw = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    sample = (rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
              .select("lang", F.col("text").cast("binary").alias("text")))  # bytes need not be UTF-8

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                group: list[bytes] = []
                for t in texts:
                    group.append(bytes(t).translate(LOWER))
                    if sum(map(len, group)) > 4 * CHUNK:
                        yield _counted(lang, group)
                        group = []
                if group:
                    yield _counted(lang, group)

    counted = sample.mapInPandas(released(run), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    return counted.toPandas()


def _counted(lang: str, texts: list[bytes]) -> pd.DataFrame:
    runs = np.concatenate([_runs(b"\0\0\0" + t) for t in texts if t] or [np.zeros(0, dtype=np.uint32)])
    value, n = np.unique(runs, return_counts=True)
    return pd.DataFrame({"lang": lang, "run": value.astype(np.int64), "n": n})


class Model:
    """Code lengths (bits) of symbols and sums of escapes, per order, for all languages."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique().tolist())
        per = [counts[counts["lang"] == lang] for lang in self.languages]
        size = len(self.languages)
        self.runs: list[np.ndarray] = []  # by order: sorted runs seen in any language
        self.bits: list[np.ndarray] = []  # their code lengths, a column per language
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []  # escape costs summed from order 0 up
        below = np.full((1, size), 8.0)
        for order in range(ORDER + 1):
            mask = np.int64((1 << (8 * (order + 1))) - 1)
            tables = []
            for c in per:
                run, back = np.unique(c["run"].to_numpy(np.int64) & mask, return_inverse=True)
                n = np.bincount(back, weights=c["n"].to_numpy(np.float64), minlength=len(run))
                context, which = np.unique(run >> 8, return_inverse=True)
                total = np.bincount(which, weights=n, minlength=len(context))
                kinds = np.bincount(which, minlength=len(context)).astype(np.float64)
                tables.append((run, np.log2((total + kinds)[which]) - np.log2(n), context, np.log2(total + kinds) - np.log2(kinds)))
            runs = np.unique(np.concatenate([t[0] for t in tables])) if tables else np.zeros(0, np.int64)
            contexts = np.unique(runs >> 8)
            shorter = mask >> 8
            bits = (below[np.searchsorted(self.runs[-1], runs & shorter)] if order
                    else np.repeat(below, len(runs), axis=0)).copy()
            escape = np.zeros((len(contexts), size))
            for lang, (run, cost, context, leave) in enumerate(tables):
                escape[np.searchsorted(contexts, context), lang] = leave
                bits[:, lang] += escape[np.searchsorted(contexts, runs >> 8), lang]
                bits[np.searchsorted(runs, run), lang] = cost
            if order:
                escape += self.escapes[-1][np.searchsorted(self.contexts[-1], contexts & (shorter >> 8))]
            below = bits
            self.runs.append(runs)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escape)
        # a slot for every hash of a longest run; runs of one slot lie side by side
        self.slots = max(16, int(np.ceil(np.log2(max(2, len(self.runs[-1]))))) + 3)
        slot = self._slot(self.runs[-1].astype(np.uint32))
        order = np.argsort(slot, kind="stable")
        self.slot_runs = np.append(self.runs[-1][order].astype(np.uint32), np.uint32(0))
        self.slot_bits = self.bits[-1][order].astype(np.float32)
        counts_ = np.bincount(slot, minlength=1 << self.slots)
        self.begin = (np.cumsum(counts_) - counts_).astype(np.int32)
        self.longest = int(counts_.max()) if len(slot) else 0

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (runs * np.uint32(2654435761)) >> np.uint32(32 - self.slots)

    def _rare(self, runs: np.ndarray) -> np.ndarray:
        """Code lengths of runs whose longest form no language has seen."""
        runs = runs.astype(np.int64)
        out = np.full((len(runs), len(self.languages)), 8.0)
        todo = np.arange(len(runs))
        top = np.zeros_like(out)  # escapes of all contexts seen
        for order in range(ORDER, -1, -1):
            context = (runs >> 8) & ((1 << (8 * order)) - 1)
            at, ok = _find(self.contexts[order], context)
            fresh = ok & (top.max(axis=1) == 0)
            top[fresh] = self.escapes[order][at[fresh]]
        for order in range(ORDER - 1, -1, -1):
            run = runs[todo] & ((1 << (8 * (order + 1))) - 1)
            at, ok = _find(self.runs[order], run)
            here = todo[ok]
            context, _ = _find(self.contexts[order], run[ok] >> 8)
            out[here] = self.bits[order][at[ok]] + top[here] - self.escapes[order][context]
            todo = todo[~ok]
        out[todo] += top[todo]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text, a column per language."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, bytes]] = []
        size = 0
        step = max(1 << 12, CHUNK // max(1, len(self.languages) // 4))
        for i, t in enumerate(texts):
            for begin in range(0, len(t), step):
                part = t[max(0, begin - ORDER):begin + step].translate(LOWER)
                group.append((i, b"\0" * (ORDER - min(begin, ORDER)) + part))
                size += len(part)
                if size >= step:
                    self._add(out, group)
                    group, size = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, bytes]]) -> None:
        runs = _runs(b"".join(p for _, p in group))
        n = np.array([len(p) - ORDER for _, p in group])
        begin = np.cumsum(n + ORDER) - (n + ORDER)
        ends = np.cumsum(n)
        runs = runs[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]
        slot = self._slot(runs)
        at = self.begin[slot]
        found = self.slot_runs[at] == runs
        open_ = np.flatnonzero(~found)
        for probe in range(1, self.longest):
            next_ = np.minimum(at[open_] + probe, len(self.slot_runs) - 1)
            hit = self.slot_runs[next_] == runs[open_]
            at[open_[hit]] = next_[hit]
            found[open_[hit]] = True
            open_ = open_[~hit]
        found &= at < len(self.slot_bits)
        open_ = np.flatnonzero(~found)
        at[open_] = 0
        bits = self.slot_bits[at]
        if len(open_):
            bits[open_] = self._rare(runs[open_])
        total = np.add.reduceat(bits.astype(np.float64), ends - n, axis=0)
        np.add.at(out, [i for i, _ in group], total)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        worded = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if worded:
            lengths = self.lengths([texts[i] for i in worded])
            best = np.argmin(lengths, axis=1)
            gap = lengths - lengths[np.arange(len(best)), best][:, None]
            share = 1 / np.sum(np.exp2(-np.minimum(gap, 1000)), axis=1)
            for i, b, s in zip(worded, best.tolist(), share.tolist()):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def train(training: DataFrame, sample_docs: int = 2000) -> Model:
    return Model(count_runs(training, sample_docs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; reads the text only."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text_at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            names, scores = model.predict(batch.column(text_at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                                             names=[*rest, "lang_pred", "score"])

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest).mapInArrow(released(run), schema)


def is_held_out(doc_id: Column, folds: int = 4, held_out: int = 2) -> Column:
    """Whether crc32 of the id as text (null: empty) falls into the held-out fold."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == held_out
