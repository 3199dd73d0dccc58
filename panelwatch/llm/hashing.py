"""64-bit polynomial fingerprints of substrings, words and word n-grams, whole chunks at a time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_WORD = _BLANK.copy()
_NOT_WORD[[c for c in range(0x20, 0x7F) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        grown = np.full(size, base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = known = np.multiply.accumulate(grown)
    return known[:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of ``h``; another permutation for each salt."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & _MASK)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Fingerprints:
    """Fingerprints of any substring of one byte string, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * _power(_BASE, n), out=self._sums[1:])
        self._back = _power(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._back[starts], 1)

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of this length, by start."""
        return mixed((self._sums[length:] - self._sums[:-length]) * self._back[: len(self._sums) - length], 1)


def words(texts: list[bytes], punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the number of words before each text (one entry more than texts).

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and return; A-Z are lower-cased.
    Without ``punctuation``, ASCII signs end words too.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    blank = _BLANK if punctuation else _NOT_WORD
    edge = np.diff(np.concatenate(([0], (~blank[data]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return Fingerprints(data).of(starts, ends), np.searchsorted(starts, text_starts)


def grams(word: np.ndarray, bounds: np.ndarray, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words at ``offsets`` from each position, inside its text, and how many lie before each text."""
    span = offsets[-1]
    counts = np.maximum(np.diff(bounds) - span, 0)
    before = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(bounds[:-1] - before[:-1], counts) + np.arange(before[-1])
    total = np.zeros(len(at), dtype=np.uint64)
    for k, offset in enumerate(offsets):
        total = total * np.uint64(0x9E6C63D0876A9A35) + mixed(word[at + offset], 17 + k)
    return mixed(total, salt), before


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of every ``length`` consecutive values, by the place of the first."""
    if len(values) < length:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * _power(_INVERSE, len(values) + 1)[: len(sums) - length], 3)
