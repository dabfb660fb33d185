"""ALAC frames side by side. Within a frame each sample depends on those before, but frames don't depend on each other: here a step takes the
next sample of all frames at once, so the cost of a step is shared by as many frames as a batch of files has."""

from __future__ import annotations

import numpy as np

#: Lanes from which steps side by side are cheaper than one frame after the other.
ENOUGH = 24


class Words:
    """The bits of several frames as 64-bit words that begin at every byte."""

    def __init__(self, frames: list[bytes]):
        raw = np.frombuffer(b"".join(f + bytes(16) for f in frames), np.uint8)
        sizes = np.array([len(f) for f in frames], np.int64)
        self.begin = 8 * (np.cumsum(sizes + 16) - sizes - 16)
        self.end = self.begin + 8 * sizes
        grid = np.lib.stride_tricks.sliding_window_view(raw, 8)
        self.words = np.ascontiguousarray(grid).view(">u8").reshape(-1).astype(np.uint64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each place; zeros after a frame's end."""
        at = np.minimum(at, 8 * (len(self.words) - 1))
        return ((self.words[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Bits of non-negative numbers below 2 ** 32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _golomb(w: Words, at: np.ndarray, k: np.ndarray, m: np.ndarray, escape: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A value of each lane, and where its code ends."""
    ones = 32 - _lengths(~w.peek(at) & 0xFFFFFFFF)
    escaped = ones >= most
    at = at + np.where(escaped, most, ones + 1)
    word, k_ = w.peek(at), np.where(escaped, escape, k)
    low = word >> (32 - k_)
    value = np.where(escaped, low, ones * m + np.maximum(low - 1, 0))
    return value, at + k_ - (~escaped & (low < 2))


def decode_errors(w: Words, lane: np.ndarray, at: np.ndarray, n: np.ndarray, bits: np.ndarray, pb: np.ndarray, mb: np.ndarray, kb: np.ndarray, fixed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors (a row for each lane), where each lane's codes end, and which lanes went wrong. fixed: the format's constants."""
    out, bad, done = np.zeros((len(n), int(n.max(initial=0))), np.int64), np.zeros(len(n), bool), np.zeros(len(n), np.int64)
    at, mean, zero = at.copy(), mb.copy(), np.zeros(len(n), np.int64)
    open_ = np.flatnonzero(n > 0)
    while len(open_):
        p, old, mask = at[open_], mean[open_], kb[open_]
        k = np.minimum(_lengths((old >> fixed.SCALE_BITS) + 3) - 1, mask)
        code, p = _golomb(w, p, k, (1 << k) - 1, bits[open_], fixed.MAX_PREFIX)
        signed = code + zero[open_]
        out[open_, done[open_]] = np.where(signed & 1, -((signed + 1) >> 1), signed >> 1)
        done[open_] += 1
        new = np.where(code > fixed.MEAN_LIMIT, fixed.MEAN_LIMIT, pb[open_] * signed + old - (pb[open_] * old >> fixed.SCALE_BITS))
        zero[open_] = 0
        at[open_], mean[open_] = p, new
        runs = open_[(new << fixed.ZERO_SHIFT < 1 << fixed.SCALE_BITS) & (done[open_] < n[open_])]
        if len(runs):
            low = mean[runs]
            k = 32 - _lengths(low) - fixed.ZERO_OFFSET + ((low + (1 << (fixed.ZERO_ROUND_BITS - 2))) >> fixed.ZERO_ROUND_BITS)
            run, at[runs] = _golomb(w, at[runs], k, ((1 << k) - 1) & ((1 << kb[runs]) - 1), np.full(len(runs), fixed.RUN_BITS), fixed.MAX_PREFIX)
            done[runs] += run
            zero[runs], mean[runs] = run < fixed.MEAN_LIMIT, 0
        bad |= (done > n) | (at > w.end[lane])
        open_ = open_[(done[open_] < n[open_]) & ~bad[open_]]
    return out, at, bad


def _wrap(x: np.ndarray, bits) -> np.ndarray:
    half = np.int64(1) << (bits - 1)
    return ((x + half) & (2 * half - 1)) - half


def undo_filter(errors: np.ndarray, taps: np.ndarray, bits: np.ndarray, shift: int) -> np.ndarray:
    """Samples of lanes (rows) whose errors these are; taps: a row for each lane, the newest sample's first."""
    lanes, length = errors.shape
    n = taps.shape[1]
    if not n or not length:
        return errors
    taps, x = taps[:, ::-1].copy(), np.empty((length, lanes), np.int64)  # oldest first; a step's samples lie together
    x[0] = errors[:, 0]
    weights, half, columns = np.arange(1, n + 1), 1 << (shift - 1), np.ascontiguousarray(errors.T)
    for j in range(1, length):
        error = columns[j]
        if j <= n:
            x[j] = _wrap(x[j - 1] + error, bits)
            continue
        top = x[j - n - 1]
        away = (x[j - n : j] - top).T
        x[j] = _wrap(top + (((taps * away).sum(1) + half) >> shift) + error, bits)
        sign = np.sign(error)
        share = (sign[:, None] * np.abs(away) >> shift) * sign[:, None] * weights
        spent = np.cumsum(share, 1) - share
        moved = np.where(np.abs(error)[:, None] > spent, sign[:, None] * np.sign(away), 0)
        taps = _wrap(taps + moved, 16)
    return x.T
