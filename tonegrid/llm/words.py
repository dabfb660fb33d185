"""Words and hashed features of whole texts, in numpy: no Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import buffers, mix

#: The bytes that end words (space, and tab to carriage return).
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: An odd number, its powers and those of its inverse name positions in the polynomial hash.
BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[i] = np.cumprod(out)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words end in the list of all (one more than texts), and a 64-bit hash of each word, A-Z as a-z."""
    ends, raw = buffers(texts)
    if not len(raw):
        return np.zeros(len(ends), np.int64), np.zeros(0, np.uint64)
    low = _LOWER[raw]
    inside = _IS_WORD[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(raw)]
    start[firsts] = inside[firsts]  # a word never crosses texts
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | start[1:]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _power(len(raw))
    summed = np.empty(len(raw) + 1, np.uint64)
    summed[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=summed[1:])
    hashes = mix((summed[end] - summed[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return np.searchsorted(begin, ends), hashes


def pair_hashes(ends: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of so many words in a row, as word_hashes() gives words; a text with fewer words has them all as its one shingle."""
    counts = np.diff(ends)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_ends = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(ends[:-1] - out_ends[:-1], n) + np.arange(out_ends[-1])
    width = np.repeat(np.minimum(counts, words), n)
    out = np.zeros(len(begin), np.uint64)
    for j in range(words):
        has = width > j
        step = mix(out * np.uint64(3) + hashes[np.minimum(begin + j, max(len(hashes) - 1, 0))] + np.uint64(j + 1)) if len(hashes) else out
        out = np.where(has, step, out)
    return out_ends, out
