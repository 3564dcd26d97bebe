"""Hashes of the words of a batch of texts, straight from Arrow's buffers: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240)
#: A random 64-bit value for each byte, and odd multipliers for the places of a word and of a window.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(n, _ODD, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: pa.Array, lower: bool = True, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's begin, with the total at the end); null texts have none.

    A word is a run of bytes other than space and \\t \\n \\v \\f \\r; ``lower`` lowers A-Z. ``keep``, 256 flags, names the bytes
    that count as part of a word instead.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_BLANK[data] if keep is None else keep[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(first, append=len(at)))
    values = _BYTE[_LOWER[data[at]] if lower else data[at]] * powers(int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(values, first)), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n of the words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k, p in enumerate(powers(n + 1)[1:]):
        total += words[k : len(words) - n + 1 + k] * p
    return mixed(total)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of n words, sorted; of fewer words, the whole sequence; of none, nothing."""
    if len(words) == 0:
        return words
    return np.unique(windows(words, min(n, len(words))) + np.uint64(max(0, n - len(words))))
