"""Bit strings: writers gather values, readers hold the whole string as one integer or as an array of bits."""

from __future__ import annotations

import functools

import numpy as np

from ..model import AudioError


class BitWriter:
    """Bits from the highest of each value; a byte string once done."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.length = 0
        self.value = self.count = 0  # single values since the last array of bits, as one number

    def put(self, value: int, count: int) -> None:
        """The lowest `count` bits of value (0 to 64)."""
        if not 0 <= count <= 64:
            raise ValueError("0 to 64 bits")
        self.value = self.value << count | value & ((1 << count) - 1)
        self.count += count
        self.length += count

    def put_signed(self, value: int, count: int) -> None:
        self.put(value & ((1 << count) - 1), count)

    def _flush(self) -> None:
        if self.count:
            rest = -self.count % 8
            self.parts.append(np.unpackbits(np.frombuffer((self.value << rest).to_bytes((self.count + rest) // 8, "big"), np.uint8))[: self.count])
            self.value = self.count = 0

    def put_bits(self, bits: np.ndarray) -> None:
        self._flush()
        self.parts.append(bits)
        self.length += len(bits)

    def put_many(self, values: np.ndarray, count: int) -> None:
        """All values with `count` bits each (two's complement, if negative)."""
        shifts = np.arange(count - 1, -1, -1, dtype=np.int64)
        self.put_bits((values.astype(np.int64)[:, None] >> shifts & 1).astype(np.uint8).reshape(-1))

    def align(self) -> None:
        if rest := -self.length % 8:
            self.put(0, rest)

    def to_bytes(self) -> bytes:
        self._flush()
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


def rice_bits(codes: np.ndarray, sizes: list[int], parameters: list[int], width: int) -> np.ndarray:
    """Rice codes of non-negative numbers in partitions: each partition's parameter k with `width` bits, then for each
    number its quotient in unary (zeros, then a one) and its k low bits."""
    if not len(codes):
        return np.zeros(0, np.uint8)
    k = np.repeat(np.array(parameters, np.int64), sizes)
    heads = np.cumsum([0, *sizes[:-1]])
    lengths = (codes >> k) + 1 + k
    lengths[heads] += width
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    stops = ends - k - 1
    out[stops] = 1
    for j in range(int(k.max(initial=0))):
        own = np.flatnonzero(k > j) if min(parameters) <= j else slice(None)
        out[stops[own] + 1 + j] = codes[own] >> (k[own] - 1 - j) & 1
    starts = (ends - lengths)[heads]
    for j in range(width):
        out[starts + j] = np.array(parameters) >> (width - 1 - j) & 1
    return out


class BitReader:
    """Bits of a byte string from the highest of each byte; reading past the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.data, self.at = data, at * 8
        self._ones = self._plain = None

    @property
    def left(self) -> int:
        return len(self.bits) - self.at

    def read(self, count: int) -> int:
        at = self.at
        if count > len(self.bits) - at:
            raise AudioError("bits: past the end")
        self.at = at + count
        if not count:
            return 0
        first, last = at >> 3, (at + count + 7) >> 3
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - at - count) & ((1 << count) - 1)

    def read_signed(self, count: int) -> int:
        value = self.read(count)
        return value - (1 << count) if count and value >> (count - 1) else value

    def read_many(self, n: int, count: int) -> np.ndarray:
        """n signed values of `count` bits each."""
        if n * count > self.left:
            raise AudioError("bits: past the end")
        if not count:
            return np.zeros(n, np.int64)
        grid = self.bits[self.at : self.at + n * count].reshape(n, count).astype(np.int64)
        self.at += n * count
        values = grid @ (1 << np.arange(count - 1, -1, -1, dtype=np.int64))
        return np.where(grid[:, 0] == 1, values - (1 << count), values)

    @property
    def ones(self) -> np.ndarray:
        """Places of all ones, for unary codes."""
        if self._ones is None:
            self._ones = np.flatnonzero(self.bits)
        return self._ones

    @property
    def plain(self) -> bytes:
        """The bits as bytes of 0 and 1."""
        if self._plain is None:
            self._plain = self.bits.tobytes()
        return self._plain

    def unary(self) -> int:
        """Zeros before the next one."""
        i = int(np.searchsorted(self.ones, self.at))
        if i >= len(self.ones):
            raise AudioError("bits: unary code runs past the end")
        n = int(self.ones[i]) - self.at
        if n > 1_000_000:
            raise AudioError("bits: unary code is too long")
        self.at += n + 1
        return n

    def rice(self, n: int, k: int) -> np.ndarray:
        """n Rice codes. With k bits after each one, where a code ends is where the next begins, so the ones are followed one by one."""
        if not n:
            return np.zeros(0, np.int64)
        if k == 0:
            i = int(np.searchsorted(self.ones, self.at))
            if i + n > len(self.ones):
                raise AudioError("bits: past the end")
            stops = self.ones[i : i + n]
        else:
            found, find, at = [], self.plain.find, self.at
            for _ in range(n):
                at = find(1, at)
                if at < 0:
                    raise AudioError("bits: past the end")
                found.append(at)
                at += 1 + k
            stops = np.array(found, np.int64)
        if stops[-1] + 1 + k > len(self.bits):
            raise AudioError("bits: past the end")
        begins = np.concatenate([[self.at], stops[:-1] + 1 + k])
        values = stops - begins
        for j in range(k):
            values = values << 1 | self.bits[stops + 1 + j]
        self.at = int(stops[-1]) + 1 + k
        return values

    def align(self) -> None:
        self.at = (self.at + 7) // 8 * 8


def crc_table(poly: int, width: int) -> list[int]:
    """Table of a CRC that takes the highest bit first."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out.append(r)
    return out


#: Polynomials of FLAC's two checks and of Ogg pages.
_TABLES = {(w, p): crc_table(p, w) for w, p in ((8, 0x07), (16, 0x8005), (32, 0x04C11DB7))}


#: Bytes that are checked at a time.
SLICE = 256


@functools.cache
def _contributions(width: int) -> np.ndarray:
    """[place, value]: what a byte at this place of a slice adds to the check after the slice."""
    table = np.array(next(t for (w, _), t in _TABLES.items() if w == width), np.uint32)
    out, mask = np.zeros((SLICE, 256), np.uint32), np.uint32((1 << width) - 1)
    out[-1] = table
    for place in range(SLICE - 2, -1, -1):
        later = out[place + 1]
        out[place] = (later << np.uint32(8) & mask) ^ table[later >> np.uint32(width - 8)]
    return out


def crc(data: bytes, width: int) -> int:
    """CRC-8 or CRC-16 as FLAC has them, or CRC-32 as Ogg pages have it: no reflection, start and end at zero. Checks are sums
    of what each byte adds, so slices are summed at once; the check so far is added to the first bytes of the next slice."""
    r = 0
    if len(data) < 64:
        table, mask = next(t for (w, _), t in _TABLES.items() if w == width), (1 << width) - 1
        for byte in data:
            r = (r << 8 & mask) ^ table[(r >> (width - 8)) ^ byte]
        return r
    grid = np.zeros(-(-len(data) // SLICE) * SLICE, np.uint8)
    grid[len(grid) - len(data) :] = np.frombuffer(data, np.uint8)  # zeros in front of all leave a check at zero
    adds = _contributions(width)
    for own in np.bitwise_xor.reduce(adds[np.arange(SLICE), grid.reshape(-1, SLICE)], 1).tolist():
        for place in range(width // 8):
            own ^= int(adds[place, r >> (width - 8 - 8 * place) & 255])
        r = own
    return r
