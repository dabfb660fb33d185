"""Ogg Vorbis, after the public specification: headers, floor 1, residues 0 to 2, coupling, transform and overlap."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..model import MAX_RATE, AudioError
from . import ogg

#: The marks with which codecs begin their first packet.
MARKS = ((b"\x01vorbis", "vorbis"), (b"OpusHead", "opus"), (b"\x7fFLAC", "flac"), (b"Speex   ", "speex"), (b"\x80theora", "theora"))
#: Limits, a codebook's mark, floor ranges by multiplier, bits looked up at once.
MAX_CHANNELS, MAX_BLOCK, BOOK_MARK, RANGES, LOOK = 16, 8192, 0x564342, (256, 128, 86, 64), 10


def codec_name(data: bytes) -> str:
    """The codec of an Ogg file by the mark in its first pages."""
    return next((name for mark, name in MARKS if mark in data[:4096]), "unknown")


class Bits:
    """Bits from the lowest of each byte. past: set once something was read beyond the end, which ends a packet, not the stream."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at, self.past = int.from_bytes(data, "little"), 8 * len(data), 0, False

    def read(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            self.past = True
            return 0
        return self.value >> (self.at - n) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return self.value >> self.at & ((1 << n) - 1)


class EndOfPacket(Exception):
    pass


class Header(Bits):
    """Headers must be whole."""

    def read(self, n: int) -> int:
        value = super().read(n)
        if self.past:
            raise AudioError("vorbis: a header is truncated")
        return value


def bits_for(n: int) -> int:
    return n.bit_length() if n > 0 else 0


def unpack_float(x: int) -> float:
    """The format's own 32-bit float: sign, exponent, 21-bit mantissa."""
    mantissa = x & 0x1FFFFF
    return (-mantissa if x >> 31 else mantissa) * 2.0 ** ((x >> 21 & 0x3FF) - 788)


def lattice_side(entries: int, dims: int) -> int:
    """The largest n with n ** dims at most entries."""
    n = int(round(entries ** (1 / dims)))
    while n**dims > entries:
        n -= 1
    while (n + 1) ** dims <= entries:
        n += 1
    return n


def code_words(lengths: list[int]) -> list[int]:
    """The code of each entry (0 where unused): each takes the lowest free code of its length. Codes must fill the tree, but for a single one."""
    free: dict[int, int] = {}  # by length: the one subtree that is free at this depth
    out, used = [0] * len(lengths), 0
    for i, n in enumerate(lengths):
        if not n:
            continue
        used += 1
        if used == 1:
            code = 0
            free = {d: 1 for d in range(1, n + 1)}
        else:
            depth = max((d for d in free if d <= n), default=0)
            if not depth:
                raise AudioError("vorbis: a codebook is overfull")
            code = free.pop(depth) << (n - depth)
            for d in range(depth + 1, n + 1):
                free[d] = (code >> (n - d)) | 1
        out[i] = code
    if free and used != 1:
        raise AudioError("vorbis: a codebook is incomplete")
    return out


class Book:
    def __init__(self, r: Header):
        if r.read(24) != BOOK_MARK:
            raise AudioError("vorbis: lost codebook sync")
        self.dims, self.entries = r.read(16), r.read(24)
        lengths = self._lengths(r)
        self.table: dict[tuple[int, int], int] = {}
        self.look: list = [None] * (1 << LOOK)
        for entry, (n, code) in enumerate(zip(lengths, code_words(lengths))):
            if n:
                turned = int(format(code, f"0{n}b")[::-1], 2)
                self.table[n, turned] = entry
                if n <= LOOK:
                    for high in range(1 << (LOOK - n)):
                        self.look[high << n | turned] = (n, entry)
        self.longest = max(lengths, default=0)
        self.vectors = self._vectors(r)

    def _lengths(self, r: Header) -> list[int]:
        if r.read(1):  # ordered: how many entries have each length
            lengths, n = [], r.read(5) + 1
            while len(lengths) < self.entries:
                count = r.read(bits_for(self.entries - len(lengths)))
                if n > 32 or len(lengths) + count > self.entries:
                    raise AudioError("vorbis: bad codebook lengths")
                lengths += [n] * count
                n += 1
            return lengths
        if r.read(1):
            return [r.read(5) + 1 if r.read(1) else 0 for _ in range(self.entries)]
        return [r.read(5) + 1 for _ in range(self.entries)]

    def _vectors(self, r: Header) -> np.ndarray | None:
        kind = r.read(4)
        if kind == 0:
            return None
        if kind > 2 or not self.dims:
            raise AudioError("vorbis: unknown codebook lookup")
        low, step, width, sequence = unpack_float(r.read(32)), unpack_float(r.read(32)), r.read(4) + 1, r.read(1)
        n = lattice_side(self.entries, self.dims) if kind == 1 else self.entries * self.dims
        if n * width > r.size:
            raise AudioError("vorbis: a header is truncated")
        values = np.array([r.read(width) for _ in range(n)], np.float64)
        if kind == 1:
            places = np.arange(self.entries)[:, None] // (n ** np.arange(self.dims))[None] % n
            grid = values[places]
        else:
            grid = values.reshape(self.entries, self.dims)
        grid = grid * step + low
        return np.cumsum(grid, 1) if sequence else grid

    def symbol(self, r: Bits) -> int:
        hit = self.look[r.peek(LOOK)]
        if hit is None:
            for n in range(LOOK + 1, self.longest + 1):
                entry = self.table.get((n, r.peek(n)))
                if entry is not None:
                    hit = (n, entry)
                    break
        if hit is None or r.at + hit[0] > r.size:
            raise EndOfPacket
        r.at += hit[0]
        return hit[1]


class Floor:
    """Floor 1: a curve of straight pieces through points."""

    def __init__(self, r: Header, books: list[Book]):
        self.classes_of = [r.read(4) for _ in range(r.read(5))]
        self.classes = []
        for _ in range(max(self.classes_of, default=-1) + 1):
            dims, sub = r.read(3) + 1, r.read(2)
            master = r.read(8) if sub else None
            self.classes.append((dims, sub, master, [r.read(8) - 1 for _ in range(1 << sub)]))
        self.multiplier, width = r.read(2) + 1, r.read(4)
        self.x = [0, 1 << width] + [r.read(width) for c in self.classes_of for _ in range(self.classes[c][0])]
        if len(set(self.x)) != len(self.x) or len(self.x) > 65:
            raise AudioError("vorbis: floor points repeat")
        if any(b >= len(books) for _, _, m, subs in self.classes for b in [*subs, m or 0]):
            raise AudioError("vorbis: a floor names no codebook")
        self.order = np.argsort(self.x, kind="stable").tolist()
        # For each point the nearest ones before it in the list, on either side.
        self.sides = [(max((j for j in range(i) if self.x[j] < self.x[i]), key=lambda j: self.x[j]), min((j for j in range(i) if self.x[j] > self.x[i]), key=lambda j: self.x[j])) for i in range(2, len(self.x))]

    def read(self, r: Bits, books: list[Book]) -> list[int] | None:
        if not r.read(1):
            return None
        width = bits_for(RANGES[self.multiplier - 1] - 1)
        y = [r.read(width), r.read(width)]
        for c in self.classes_of:
            dims, sub, master, subs = self.classes[c]
            value = books[master].symbol(r) if sub else 0
            for _ in range(dims):
                book = subs[value & ((1 << sub) - 1)]
                value >>= sub
                y.append(books[book].symbol(r) if book >= 0 else 0)
        if r.past:
            raise EndOfPacket
        return y

    def curve(self, y: list[int], n: int) -> np.ndarray:
        """Amplitudes of n lines."""
        top, x = RANGES[self.multiplier - 1], self.x
        final, used = list(y[:2]), [True, True]
        for i, (a, b) in enumerate(self.sides, 2):
            guess = point(x[a], final[a], x[b], final[b], x[i])
            value, above, below = y[i], top - guess, guess
            room = 2 * min(above, below)
            if not value:
                final.append(guess)
                used.append(False)
                continue
            used[a] = used[b] = True
            used.append(True)
            if value >= room:
                final.append(value - below + guess if above > below else guess - value + above - 1)
            else:
                final.append(guess - (value + 1) // 2 if value & 1 else guess + value // 2)
        out, lx, ly = np.zeros(n, np.int64), 0, final[self.order[0]] * self.multiplier
        for i in self.order[1:]:
            if used[i]:
                hx, hy = x[i], final[i] * self.multiplier
                line(lx, ly, hx, hy, out)
                lx, ly = hx, hy
        if lx < n:
            out[lx:] = ly
        return 10.0 ** ((np.clip(out, 0, 255) - 255) * 7 / 256)


def point(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    """The height at x on the way between two points, in integers: steps are cut towards the first."""
    off = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - off if y1 < y0 else y0 + off


def line(x0: int, y0: int, x1: int, y1: int, out: np.ndarray) -> None:
    """Heights from x0 to before x1, as far as out goes; whole steps, and one more where the remainders add up."""
    steps = np.arange(max(0, min(x1, len(out)) - x0))
    wide, rise = x1 - x0, abs(y1 - y0)
    out[x0 : x0 + len(steps)] = y0 + (1 if y1 >= y0 else -1) * (steps * rise // wide)


class Residue:
    def __init__(self, r: Header, kind: int, books: list[Book]):
        if kind > 2:
            raise AudioError(f"vorbis: residue {kind} is not decoded")
        self.kind = kind
        self.begin, self.end, self.size, self.n, self.book = r.read(24), r.read(24), r.read(24) + 1, r.read(6) + 1, r.read(8)
        passes = [r.read(3) | (r.read(5) << 3 if r.read(1) else 0) for _ in range(self.n)]
        self.books = [[r.read(8) if p >> i & 1 else -1 for i in range(8)] for p in passes]
        named = [self.book, *(b for row in self.books for b in row if b >= 0)]
        if any(b >= len(books) for b in named) or any(books[b].vectors is None for b in named[1:]) or not books[self.book].dims:
            raise AudioError("vorbis: a residue names no codebook")
        if any(self.size % books[b].dims for b in named[1:]):
            raise AudioError("vorbis: a residue's vectors don't fit")

    def read(self, r: Bits, books: list[Book], n: int, skip: list[bool]) -> list[np.ndarray]:
        """Spectra of channels, n lines each; skipped ones stay zero."""
        if self.kind == 2:
            flat = [np.zeros(n * len(skip))]
            if not all(skip):
                self._fill(r, books, flat, [False])
            return list(flat[0].reshape(n, len(skip)).T)
        out = [np.zeros(n) for _ in skip]
        self._fill(r, books, out, skip)
        return out

    def _fill(self, r: Bits, books: list[Book], out: list[np.ndarray], skip: list[bool]) -> None:
        end = min(self.end, len(out[0]))
        parts = max(0, end - min(self.begin, end)) // self.size
        each = books[self.book].dims
        kinds = [[0] * (parts + each) for _ in out]
        try:
            for step in range(8):
                p = 0
                while p < parts:
                    if step == 0:
                        for c, x in enumerate(out):
                            if not skip[c]:
                                value = books[self.book].symbol(r)
                                for i in range(each - 1, -1, -1):
                                    kinds[c][p + i] = value % self.n
                                    value //= self.n
                    for _ in range(each):
                        if p >= parts:
                            break
                        for c, x in enumerate(out):
                            book = -1 if skip[c] else self.books[kinds[c][p]][step]
                            if book >= 0:
                                self._vectors(r, books[book], x, self.begin + p * self.size)
                        p += 1
        except EndOfPacket:
            pass  # what was read so far holds

    def _vectors(self, r: Bits, book: Book, x: np.ndarray, at: int) -> None:
        if self.kind == 0:  # a vector's components lie apart
            apart = self.size // book.dims
            for i in range(apart):
                x[at + i : at + self.size : apart] += book.vectors[book.symbol(r)]
            return
        for i in range(at, at + self.size, book.dims):
            x[i : i + book.dims] += book.vectors[book.symbol(r)]


class Mapping:
    def __init__(self, r: Header, channels: int, floors: int, residues: int):
        if r.read(16):
            raise AudioError("vorbis: unknown mapping")
        submaps = r.read(4) + 1 if r.read(1) else 1
        width = bits_for(channels - 1)
        self.coupling = [(r.read(width), r.read(width)) for _ in range(r.read(8) + 1)] if r.read(1) else []
        if any(a == b or max(a, b) >= channels for a, b in self.coupling):
            raise AudioError("vorbis: bad coupling")
        if r.read(2):
            raise AudioError("vorbis: reserved mapping bits are set")
        self.mux = [r.read(4) for _ in range(channels)] if submaps > 1 else [0] * channels
        self.submaps = [(r.read(8), r.read(8), r.read(8))[1:] for _ in range(submaps)]
        if max(self.mux) >= submaps or any(f >= floors or s >= residues for f, s in self.submaps):
            raise AudioError("vorbis: bad submap")


class Setup:
    """What the three header packets say."""

    def __init__(self, packets: list[dict]):
        if not packets or not packets[0]["data"].startswith(b"\x01vorbis"):
            name = next((n for mark, n in MARKS if packets and packets[0]["data"].startswith(mark)), "unknown")
            raise AudioError(f"ogg: {name} is not decoded")
        if len(packets) < 3 or packets[1]["data"][:7] != b"\x03vorbis" or packets[2]["data"][:7] != b"\x05vorbis":
            raise AudioError("vorbis: a header is missing")
        r = Header(packets[0]["data"][7:])
        version, self.channels, self.rate = r.read(32), r.read(8), r.read(32)
        r.read(96)
        self.blocks = (1 << r.read(4), 1 << r.read(4))
        if version or not 1 <= self.channels <= MAX_CHANNELS or not 1 <= self.rate <= MAX_RATE or not 64 <= self.blocks[0] <= self.blocks[1] <= MAX_BLOCK:
            raise AudioError("vorbis: unsupported shape")
        r = Header(packets[2]["data"][7:])
        self.books = [Book(r) for _ in range(r.read(8) + 1)]
        if any(r.read(16) for _ in range(r.read(6) + 1)):
            raise AudioError("vorbis: bad time transform")
        self.floors = [self._floor(r) for _ in range(r.read(6) + 1)]
        self.residues = [Residue(r, r.read(16), self.books) for _ in range(r.read(6) + 1)]
        self.mappings = [Mapping(r, self.channels, len(self.floors), len(self.residues)) for _ in range(r.read(6) + 1)]
        self.modes = [(r.read(1), r.read(16), r.read(16), r.read(8)) for _ in range(r.read(6) + 1)]
        if any(w or t or m >= len(self.mappings) for _, w, t, m in self.modes) or not r.read(1):
            raise AudioError("vorbis: bad modes")

    def _floor(self, r: Header) -> Floor:
        if (kind := r.read(16)) != 1:
            raise AudioError(f"vorbis: floor {kind} is not decoded")
        return Floor(r, self.books)


@lru_cache(64)
def slope(n: int) -> np.ndarray:
    """The rising half of a window."""
    return np.sin(np.pi / 2 * np.sin((np.arange(n) + 0.5) / n * np.pi / 2) ** 2)


@lru_cache(16)
def _turns(n: int) -> tuple[np.ndarray, np.ndarray]:
    shift = 1 + n / 2
    return np.exp(-1j * np.pi * shift * np.arange(n // 2) / n), np.exp(-1j * np.pi * (2 * np.arange(n) + shift) / (2 * n))


def imdct(spectrum: np.ndarray) -> np.ndarray:
    """The inverse transform to twice as many samples, by one FFT."""
    before, after = _turns(2 * len(spectrum))
    return (np.fft.fft(spectrum * before, 2 * len(spectrum)) * after).real


def window(n: int, left: int, right: int) -> np.ndarray:
    """A block's window; left and right: lengths of the slopes."""
    out = np.zeros(n)
    a, b = n // 4 - left // 2, 3 * n // 4 - right // 2
    out[a : a + left] = slope(left)
    out[a + left : b] = 1
    out[b : b + right] = slope(right)[::-1]
    return out


def uncouple(magnitude: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = angle > 0
    moved = np.where(magnitude > 0, magnitude - np.abs(angle), magnitude + np.abs(angle))
    return np.where(out, magnitude, moved), np.where(out, moved, magnitude)


def decode_block(s: Setup, data: bytes) -> tuple[int, np.ndarray] | None:
    """Block size and windowed samples, channels in rows; None for what isn't audio."""
    r = Bits(data)
    if r.read(1) or not data:
        return None
    number = r.read(bits_for(len(s.modes) - 1))
    if r.past or number >= len(s.modes):
        return None
    long, _, _, mapping = s.modes[number]
    n = s.blocks[long]
    before, after = (r.read(1), r.read(1)) if long else (0, 0)
    m = s.mappings[mapping]
    points = []
    for c in range(s.channels):
        try:
            points.append(s.floors[m.submaps[m.mux[c]][0]].read(r, s.books))
        except EndOfPacket:
            points.append(None)
    silent = [p is None for p in points]
    needed = list(silent)
    for a, b in m.coupling:
        needed[a] = needed[b] = needed[a] and needed[b]
    spectra = [np.zeros(n // 2) for _ in range(s.channels)]
    for i, (_, residue) in enumerate(m.submaps):
        own = [c for c in range(s.channels) if m.mux[c] == i]
        for c, x in zip(own, s.residues[residue].read(r, s.books, n // 2, [needed[c] for c in own])):
            spectra[c] = x
    for a, b in reversed(m.coupling):
        spectra[a], spectra[b] = uncouple(spectra[a], spectra[b])
    w = window(n, s.blocks[before] // 2 if long else n // 2, s.blocks[after] // 2 if long else n // 2)
    planes = [np.zeros(n) if silent[c] else imdct(spectra[c] * s.floors[m.submaps[m.mux[c]][0]].curve(points[c], n // 2)) * w for c in range(s.channels)]
    return n, np.stack(planes)


def read_vorbis(data: bytes) -> tuple[int, int, np.ndarray]:
    """rate, channels and interleaved samples of the first stream, to the last granule, within -1 and 1."""
    packets = ogg.packets(data)
    s = Setup(packets)
    out, last = [], None
    for p in packets[3:]:
        found = decode_block(s, p["data"])
        if found is None:
            continue
        n, block = found
        if last is not None:
            m, old = last
            # The halves meet centred on a quarter of either block.
            span = m // 4 + n // 4
            sum_ = np.zeros((s.channels, span))
            sum_[:, : min(span, m // 2)] += old[:, m // 2 : m // 2 + min(span, m // 2)]
            begin = n // 2 - span
            if begin >= 0:
                sum_ += block[:, begin : n // 2]
            else:
                sum_[:, -begin:] += block[:, : n // 2]
            out.append(sum_)
        last = (n, block)
    planes = np.concatenate(out, 1) if out else np.zeros((s.channels, 0))
    granule = max((p["granule"] for p in packets[3:]), default=-1)
    if 0 <= granule < planes.shape[1]:
        planes = planes[:, :granule]
    return s.rate, s.channels, np.clip(planes.T.reshape(-1), -1, 1).astype(np.float32)
