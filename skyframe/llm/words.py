"""Words of texts as numpy arrays: positions and 64-bit hashes, a chunk of texts at a time.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: ASCII
digits, ASCII letters and everything beyond ASCII. In UTF-8 that is a rule on single bytes,
so the scan works on bytes and never decodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from . import modular

CHUNK = 1 << 20  # bytes handled at once; arrays take about 40 times as much


def _byte_map() -> bytes:
    out = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c in "0123456789abcdefghijklmnopqrstuvwxyz":
            out[b] = b
        elif "A" <= c <= "Z":
            out[b] = b + 32
    return bytes(out)


BYTE_MAP = _byte_map()
_BASE = 0x0F3A_5D29_C417_86E3 % modular.PRIME
_BASE_INV = pow(_BASE, -1, modular.PRIME)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 32) - 1)
_LONG = 1 << 22  # bytes whose sum of (byte * 32 bits) surely fits 64 bits
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo the prime."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = modular.Powers(base)(np.arange(max(n, CHUNK + 1)))
        if n <= 3 * CHUNK:
            _tables[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    low: bytes  # lower-cased bytes, everything between words a space
    starts: np.ndarray  # byte offsets into low
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray  # index of the text each word is from
    index: np.ndarray  # number of the word in its text

    def gram(self, k: int) -> np.ndarray:
        """Hash of the k words that begin at each word (len - k + 1 of them)."""
        n = max(0, len(self.hashes) - k + 1)
        g = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            g = g * _GRAM + self.hashes[j:j + n]
        return mix(g)

    def within(self, length: int) -> np.ndarray:
        """Whether the ``length`` words from each word on are all from one text."""
        n = max(0, len(self.hashes) - length + 1)
        return self.text[:n] == self.text[length - 1:length - 1 + n]

    def phrase(self, i: int, length: int) -> str:
        return b" ".join(self.low[s:e] for s, e in zip(self.starts[i:i + length].tolist(),
                                                       self.ends[i:i + length].tolist())).decode("utf-8", "replace")


def _spans(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.frombuffer(low, dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def hash_spans(low: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: a polynomial in them modulo a prime, mixed. (Modulo a power of
    two some words have equal hashes whatever the base.)"""
    codes = np.frombuffer(low, dtype=np.uint8).astype(np.uint64)
    powers = _powers(_BASE, len(low))
    high, rest = np.zeros(len(low) + 1, dtype=np.uint64), np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(codes * (powers >> np.uint64(32)), out=high[1:])
    np.cumsum(codes * (powers & _LOW), out=rest[1:])
    total = modular.join(high[ends] - high[starts], rest[ends] - rest[starts])
    for i in np.flatnonzero(ends - starts > _LONG).tolist():  # sums of the parts, each of which fits
        cuts = np.append(np.arange(starts[i], ends[i], _LONG), ends[i])
        parts = modular.join(np.diff(high[cuts]), np.diff(rest[cuts]))
        total[i] = sum(parts.tolist()) % modular.PRIME
    return mix(modular.mul(total, _powers(_BASE_INV, len(low) + 1)[starts]))


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of ``a`` and ``b`` (bytes as numbers) of equal, positive lengths are equal."""
    if not len(lengths):
        return np.zeros(0, dtype=bool)
    ends = np.cumsum(lengths)
    inside = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    differs = a[np.repeat(a_starts, lengths) + inside] != b[np.repeat(b_starts, lengths) + inside]
    return np.add.reduceat(differs, ends - lengths) == 0


def scan(texts: list[bytes | None], overlap: int, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of ``texts``, several short texts at once. A text longer than ``chunk`` comes in
    pieces; each piece repeats the last ``overlap`` words of the one before, so every run of
    ``overlap + 1`` words lies in exactly one piece."""
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> Words:
        low = b" ".join(parts)
        offsets = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        starts, ends = _spans(low)
        part = np.searchsorted(offsets, starts, side="right") - 1
        first = np.searchsorted(part, np.arange(len(parts)))
        return Words(low, starts, ends, hash_spans(low, starts, ends), np.asarray(owner)[part],
                     np.arange(len(starts)) - first[part])

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > chunk:
            yield from _pieces(t.translate(BYTE_MAP), i, overlap, chunk)
            continue
        if size + len(t) > chunk and parts:
            yield flush()
            parts, owner, size = [], [], 0
        parts.append(t.translate(BYTE_MAP))
        owner.append(i)
        size += len(t) + 1
    if parts:
        yield flush()


def _pieces(low: bytes, owner: int, overlap: int, chunk: int) -> Iterator[Words]:
    begin, done = 0, 0
    while begin < len(low):
        end, starts = begin, np.zeros(0, dtype=np.int64)
        while end < len(low) and len(starts) <= overlap:  # more words than the next piece repeats
            end = low.find(b" ", end + chunk)
            end = len(low) if end < 0 else end
            piece = low[begin:end]
            starts, ends = _spans(piece)
        yield Words(piece, starts, ends, hash_spans(piece, starts, ends),
                    np.full(len(starts), owner), done + np.arange(len(starts)))
        if end == len(low):
            return
        keep = len(starts) - overlap
        done += keep
        begin += int(starts[keep]) if overlap else len(piece)

