"""Polynomial hashes of byte ranges, vectorised: after one pass over a text, any of its ranges has its hash at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(0x5167).integers(0, 1 << 64, 256, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << (n + 1).bit_length()
        for base, name in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a byte array, for ``hashes``."""
    _grow(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers[: len(data)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte range [start, end); equal ranges have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * _inverses[start]


def windows(prefix: np.ndarray, width: int) -> np.ndarray:
    """The hash of every range of ``width`` bytes, in order of their starts."""
    n = len(prefix) - width
    return (prefix[width:] - prefix[:n]) * _inverses[:n] if n > 0 else np.empty(0, np.uint64)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space (space, tab to carriage return)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``width`` words, lower-cased in A-Z; with fewer words, of the whole run.

    No words, or no text: none.
    """
    data = LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
    start, end = words(data)
    if not len(start):
        return np.empty(0, np.uint64)
    word = mix(hashes(sums(data), start, end) + (end - start).astype(np.uint64))
    width = min(width, len(word))
    out = np.zeros(len(word) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out + word[k : len(word) - width + 1 + k] + np.uint64(k + 1))
    return np.unique(out)
