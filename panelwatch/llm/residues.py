"""Exact integer inner products from float32 matrix products, by residues modulo small primes."""

from __future__ import annotations

from math import isqrt

import numpy as np

# Residues lie in -(p - 1) / 2 .. (p - 1) / 2, so the sum over SLICE products of two of them stays within 2**24, where
# float32 holds every integer.
SLICE = 256
_MOST = isqrt((1 << 24) // SLICE)
PRIMES = [p for p in range(2 * _MOST + 1, 2, -2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]


def centred(v: np.ndarray, p: int) -> np.ndarray:
    """``v`` modulo ``p``, nearest to zero. Twice, as the first quotient of a large float32 may be rounded to the next one."""
    v = v - v.dtype.type(p) * np.rint(v / v.dtype.type(p))
    return v - v.dtype.type(p) * np.rint(v / v.dtype.type(p))


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Of whole numbers held as doubles, however large."""
    return centred(np.fmod(x, float(p)), p).astype(np.float32)


def moduli(bound: float) -> list[int]:
    """As many primes as tell whole numbers from -bound to bound apart."""
    if not bound < float(1 << 63):
        raise OverflowError("inner products of these vectors may not fit a long; use a smaller scale")
    product, used = 1, 0
    while product <= 2 * int(bound) + 1:
        product *= PRIMES[used]
        used += 1
    return PRIMES[: max(used, 1)]


def products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Inner products of the rows of two residue matrices modulo ``p``, one float32 product per slice of dimensions."""
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for s in range(0, a.shape[1], SLICE):
        total += centred(a[:, s : s + SLICE] @ b[:, s : s + SLICE].T, p)
    return centred(total, p)


def reconstructed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers of smallest size with these residues, by mixed-radix digits nearest to zero.

    All digits are found modulo their own prime, in float32. The sum of digits times radices lies within half of the
    product of the primes, and within a long by the choice of ``moduli``; partial sums may wrap, their end does not.
    """
    digits: list[np.ndarray] = []
    value, radix = np.zeros(parts[0].shape, dtype=np.int64), 1
    for i, p in enumerate(primes):
        digit = parts[i]
        for earlier, q in zip(digits, primes):
            inverse = pow(q, -1, p)
            digit = centred((digit - earlier) * np.float32(inverse if 2 * inverse < p else inverse - p), p)
        digits.append(digit)
        wrapped = (radix + (1 << 63)) % (1 << 64) - (1 << 63)
        value += digit.astype(np.int64) * np.int64(wrapped)
        radix *= p
    return value


class ResidueMatrix:
    """Rows of whole numbers held as doubles, with their residues modulo each prime that was asked for."""

    def __init__(self, x: np.ndarray):
        self.x = x
        largest = np.abs(x).max(initial=0.0)
        scaled = x / largest if largest else x
        self.norm = largest * float(np.sqrt((scaled * scaled).sum(axis=1).max(initial=0.0)))
        self._of: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self._of:
            self._of[p] = residues(self.x, p)
        return self._of[p]


def inner_products(a: ResidueMatrix, b: ResidueMatrix, rows: slice = slice(None)) -> np.ndarray:
    """Exact inner products of the chosen rows of ``a`` with all rows of ``b``, as longs."""
    primes = moduli(float(a.norm) * float(b.norm) * (1 + 1e-9) + 1)
    return reconstructed([products(a.modulo(p)[rows], b.modulo(p), p) for p in primes], primes)
