"""Arithmetic modulo the prime 2^61 - 1 on numpy arrays of unsigned 64-bit integers.

Polynomial hashes are taken modulo a prime: modulo a power of two some pairs of texts have
equal hashes whatever the base.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_S61, _S32, _S31, _S30 = np.uint64(61), np.uint64(32), np.uint64(31), np.uint64(30)
_M32, _M31, _M30 = np.uint64((1 << 32) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def reduce(x: np.ndarray) -> np.ndarray:
    """Any unsigned 64-bit number modulo the prime."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reduced numbers, by halves of 31 bits; 2^61 counts as one."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = a1 * b0 + a0 * b1
    return reduce(((a1 * b1) << np.uint64(1)) + (mid >> _S30) + ((mid & _M30) << _S31) + a0 * b0)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(a + b)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(a + (_P - b))


def join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2^32 + low for any unsigned 64-bit numbers."""
    return reduce(mul(reduce(high), np.uint64(1) << _S32) + reduce(low))


def running_sum(x: np.ndarray) -> np.ndarray:
    """Prefix sums of at most 2^31 reduced numbers."""
    return join(np.cumsum(x >> _S32, dtype=np.uint64), np.cumsum(x & _M32, dtype=np.uint64))


class Powers:
    """base ** exponents, for exponents of any size, from two tables of 2^16 entries."""

    def __init__(self, base: int):
        self.base = base
        self._low = self._table(base)

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out = np.ones(1 << 16, dtype=np.uint64)
        size = 1
        while size < len(out):  # doubles the table: base ** (size + i) = base ** size * base ** i
            out[size:2 * size] = mul(out[:size], np.uint64(pow(base, size, PRIME)))
            size *= 2
        return out

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        exponents = np.asarray(exponents, dtype=np.int64)
        blocks, where = np.unique(exponents >> 16, return_inverse=True)
        high = np.array([pow(self.base, int(b) << 16, PRIME) for b in blocks.tolist()], dtype=np.uint64)
        return mul(self._low[exponents & 0xFFFF], high[where.reshape(exponents.shape)])
