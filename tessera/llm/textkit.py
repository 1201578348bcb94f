"""Vectorised text primitives shared by the operators of this subpackage.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text, so
nothing depends on a Unicode version.  A word's 64-bit hash is a polynomial over its
bytes, read off prefix sums for all words of a text at once; shingle hashes combine
consecutive word hashes.  Every function is pure numpy over one text.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = _power_table(_BASE, 1 << 14)
        self.down = _power_table(_BASE_INV, 1 << 14)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _power_table(_BASE, size), _power_table(_BASE_INV, size)
        return self.up, self.down


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of a UTF-8 text; ends are exclusive."""
    data = np.frombuffer(raw, dtype=np.uint8)
    edge = np.ones(len(data) + 2, dtype=bool)
    edge[1:-1] = _SPACE[data]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return data, turns[0::2], turns[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    data, start, end = word_bounds(raw)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive word hashes (none when there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return out


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text.

    A text with fewer than k words has its whole word sequence as the only shingle; one
    without words has none.
    """
    words = word_hashes(raw)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(k, len(words))))
