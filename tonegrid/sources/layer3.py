"""MPEG audio layer 3, decoded after the public standard (ISO/IEC 11172-3 and 13818-3).

Only the code words are read bit by bit. Whatever follows works on all granules of a stream at once: requantising, stereo, reordering, alias reduction,
the inverse transforms with their overlap, and the polyphase synthesis.

Two of the standard's tables follow no rule and are far too long to be stated here: the code words of its Huffman tables (annex B, table
B.7) and the synthesis window (table B.3). They are a parameter: a text file with a line for each entry,

    code TABLE X Y BITS      (tables 1 to 13, 15, 16 and 24; BITS as zeros and ones)
    window I VALUE           (0 to 511)

Streams of silence need neither."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from ..model import AudioError

LINES, BANDS, RESERVOIR = 576, 32, 511
LONG, START, SHORT, STOP = range(4)
#: Widths of the scalefactor bands of long blocks, by sample rate.
LONG_BANDS = {
    44100: (4, 4, 4, 4, 4, 4, 6, 6, 8, 8, 10, 12, 16, 20, 24, 28, 34, 42, 50, 54, 76, 158),
    48000: (4, 4, 4, 4, 4, 4, 6, 6, 6, 8, 10, 12, 16, 18, 22, 28, 34, 40, 46, 54, 54, 192),
    32000: (4, 4, 4, 4, 4, 4, 6, 6, 8, 10, 12, 16, 20, 24, 30, 38, 46, 56, 68, 84, 102, 26),
    22050: (6, 6, 6, 6, 6, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 38, 46, 52, 60, 68, 58, 54),
    24000: (6, 6, 6, 6, 6, 6, 8, 10, 12, 14, 16, 18, 22, 26, 32, 38, 46, 54, 62, 70, 76, 36),
    8000: (12, 12, 12, 12, 12, 12, 16, 20, 24, 28, 32, 40, 48, 56, 64, 76, 90, 2, 2, 2, 2, 2),
}
#: Widths of the bands of one short block.
SHORT_BANDS = {
    44100: (4, 4, 4, 4, 6, 8, 10, 12, 14, 18, 22, 30, 56),
    48000: (4, 4, 4, 4, 6, 6, 10, 12, 14, 16, 20, 26, 66),
    32000: (4, 4, 4, 4, 6, 8, 12, 16, 20, 26, 34, 42, 12),
    22050: (4, 4, 4, 6, 6, 8, 10, 14, 18, 26, 32, 42, 18),
    24000: (4, 4, 4, 6, 8, 10, 12, 14, 18, 24, 32, 44, 12),
    16000: (4, 4, 4, 6, 8, 10, 12, 14, 18, 24, 30, 40, 18),
    8000: (8, 8, 8, 12, 16, 20, 24, 28, 36, 2, 2, 2, 26),
}
#: Rates that use another one's bands.
LIKE_LONG = {16000: 22050, 11025: 22050, 12000: 22050}
LIKE_SHORT = {11025: 16000, 12000: 16000}
#: Widths of scalefactors by scalefac_compress (first version), and how many bands have each of four widths in the second version,
#: by kind of block (long, short, mixed): three ranges of scalefac_compress, then the same for an intensity channel.
WIDTHS = ((0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3))
COUNTS = (
    ((6, 5, 5, 5), (6, 5, 7, 3), (11, 10, 0, 0), (7, 7, 7, 0), (6, 6, 6, 3), (8, 8, 5, 0)),
    ((9, 9, 9, 9), (9, 9, 12, 6), (18, 18, 0, 0), (12, 12, 12, 0), (12, 9, 9, 6), (15, 12, 9, 0)),
    ((6, 9, 9, 9), (6, 9, 12, 6), (15, 18, 0, 0), (6, 15, 12, 0), (6, 12, 9, 6), (6, 18, 9, 0)),
)
#: What preflag adds from band 11 on; extra bits of tables 16 to 31; butterfly coefficients; code words of quadruples (table A).
PRETAB = (1, 1, 1, 1, 2, 2, 3, 3, 3, 2)
LINBITS = (1, 2, 3, 4, 6, 8, 10, 13, 4, 5, 6, 7, 8, 9, 11, 13)
BUTTERFLY = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)
QUADS = ("1", "0101", "0100", "00101", "0110", "000101", "00100", "000100", "0111", "00011", "00110", "000000", "00111", "000010", "000011", "000001")


class LostFrame(AudioError):
    """A frame that can't be decoded; the stream begins anew after it."""


class Codes:
    """Code words by their first bits: PEEK bits find most, the rest are found by length."""

    PEEK = 9

    def __init__(self, words: dict[str, int]):
        self.short: list = [None] * (1 << self.PEEK)
        self.long: dict[tuple[int, int], int] = {}
        self.most = max(map(len, words), default=0)
        for bits, value in words.items():
            rest = self.PEEK - len(bits)
            if rest >= 0:
                first = int(bits, 2) << rest
                self.short[first : first + (1 << rest)] = [(len(bits), value)] * (1 << rest)
            else:
                self.long[len(bits), int(bits, 2)] = value


QUAD_CODES = (Codes({w: v for v, w in enumerate(QUADS)}), Codes({format(15 - v, "04b"): v for v in range(16)}))


@dataclass
class Tables:
    """The two tables that are a parameter."""

    codes: dict[int, Codes] = field(default_factory=dict)
    window: np.ndarray | None = None


@functools.cache
def load_tables(path: str) -> Tables:
    words: dict[int, dict[str, int]] = {}
    window = np.full(512, np.nan)
    with open(path, encoding="ascii") as f:
        for line in f:
            kind, *rest = line.split() or [""]
            if kind == "code":
                table, x, y = map(int, rest[:3])
                words.setdefault(table, {})[rest[3]] = x << 4 | y
            elif kind == "window":
                window[int(rest[0])] = float(rest[1])
    if np.isnan(window).any() or not {*range(1, 14), 15, 16, 24} - {4} <= set(words):
        raise AudioError(f"mp3: {path} doesn't have all tables")
    return Tables({t: Codes(w) for t, w in words.items()}, window)


class Bits:
    """Bits from the highest of each byte; beyond the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data + bytes(8), len(data) * 8, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 8].ljust(8, b"\0"), "big") >> (64 - (self.at & 7) - n) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        return value

    def word(self, codes: Codes) -> int:
        found = codes.short[self.peek(codes.PEEK)]
        if found:
            self.at += found[0]
            return found[1]
        for n in range(codes.PEEK + 1, codes.most + 1):
            value = codes.long.get((n, self.peek(n)))
            if value is not None:
                self.at += n
                return value
        raise LostFrame("mp3: no such code word")


def read_side(r: Bits, first: bool, channels: int) -> tuple[int, list[list[dict]]] | None:
    """How many bytes main data begins before the frame, and for each granule and channel its fields; None if it can't be."""
    begin = r.read(9 if first else 8)
    r.read({(True, 1): 5, (True, 2): 3, (False, 1): 1, (False, 2): 2}[first, channels])
    shared = [r.read(4) if first else 0 for _ in range(channels)]
    granules = []
    for g in range(2 if first else 1):
        row = []
        for c in range(channels):
            s = {"length": r.read(12), "big": r.read(9), "gain": r.read(8), "compress": r.read(4 if first else 9), "kind": LONG, "mixed": 0, "sub": (0, 0, 0)}
            if r.read(1):
                s["kind"], s["mixed"] = r.read(2), r.read(1)
                s["tables"] = [r.read(5), r.read(5), 0]
                s["sub"] = tuple(r.read(3) for _ in range(3))
                s["regions"] = None
                if s["kind"] == LONG:
                    return None
            else:
                s["tables"] = [r.read(5) for _ in range(3)]
                s["regions"] = (r.read(4) + 1, r.read(3) + 1)
            s["pre"] = r.read(1) if first else int(s["compress"] >= 500)
            s["scale"], s["quad"] = r.read(1), r.read(1)
            s["same"] = shared[c] if g and s["kind"] != SHORT else 0
            if s["big"] > 288:
                return None
            row.append(s)
        granules.append(row)
    return begin, granules


def layout(rate: int, s: dict, first: bool) -> tuple[np.ndarray, int]:
    """Widths of a granule's bands in the order in which they are coded (short ones three times each), and how many are long."""
    long, short = LONG_BANDS[LIKE_LONG.get(rate, rate)], SHORT_BANDS[LIKE_SHORT.get(rate, rate)]
    if s["kind"] != SHORT:
        return np.array(long), len(long)
    head = (8 if first else 6) if s["mixed"] else 0
    return np.array([*long[:head], *np.repeat(short[3 if head else 0 :], 3)]), head


def read_factors(r: Bits, s: dict, first: bool, right: bool, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scalefactors of the coded bands, and which of them are the highest value (no intensity position)."""
    kind = 0 if s["kind"] != SHORT else 2 if s["mixed"] else 1
    if first:
        a, b = WIDTHS[s["compress"]]
        counts = ((6, 5, 5, 5), (18, 18), (17, 18))[kind]
        widths = (a, a, b, b) if kind == 0 else (a, b)
    else:
        x = s["compress"]
        if right:
            x >>= 1
            row, widths = (3, (x // 36, x % 36 // 6, x % 6, 0)) if x < 180 else (4, ((x - 180) >> 4 & 3, (x - 180) >> 2 & 3, (x - 180) & 3, 0)) if x < 244 else (5, ((x - 244) // 3, (x - 244) % 3, 0, 0))
        else:
            row, widths = (0, ((x >> 4) // 5, (x >> 4) % 5, x >> 2 & 3, x & 3)) if x < 400 else (1, ((x - 400 >> 2) // 5, (x - 400 >> 2) % 5, x - 400 & 3, 0)) if x < 500 else (2, ((x - 500) // 3, (x - 500) % 3, 0, 0))
        counts = COUNTS[kind][row]
    factors, top = np.zeros(40, np.int64), np.zeros(40, bool)
    at = 0
    for part, (n, width) in enumerate(zip(counts, widths)):
        if s["same"] >> (3 - part) & 1:
            factors[at : at + n] = before[at : at + n]
        elif width:
            factors[at : at + n] = [r.read(width) for _ in range(n)]
            top[at : at + n] = (factors[at : at + n] == (1 << width) - 1) & (not first)
        at += n
    return factors, top


def read_lines(r: Bits, s: dict, widths: np.ndarray, end: int, tables: Tables) -> np.ndarray:
    """Quantised lines: pairs by three tables, then quadruples of ones and zeros up to the end of the granule's bits."""
    out, edges = np.zeros(LINES + 4, np.int64), np.cumsum(widths)
    if s["regions"] is None:
        # A third of the short bands, or eight long ones; mixed blocks are parted where their long bands end.
        borders = [int(edges[8]) if s["kind"] == SHORT and not s["mixed"] else int(edges[7]), LINES]
    else:
        a, b = s["regions"]
        borders = [int(edges[min(a, len(edges)) - 1]), int(edges[min(a + b, len(edges)) - 1])]
    stop, at = min(2 * s["big"], LINES), 0
    for region, upto in enumerate((*borders, LINES)):
        table, upto = s["tables"][region], min(upto, stop)
        if at >= upto:
            continue
        if table in (0, 4, 14):
            at = upto
            continue
        extra = LINBITS[table - 16] if table >= 16 else 0
        codes = tables.codes.get(table if table < 16 else 16 if table < 24 else 24)
        if codes is None:
            raise AudioError("mp3: the standard's code tables are needed; give their file as mp3_tables")
        while at < upto:
            if r.at >= end:
                return out[:LINES]
            pair = r.word(codes)
            for value in (pair >> 4, pair & 15):
                if extra and value == 15:
                    value += r.read(extra)
                if value:
                    out[at] = -value if r.read(1) else value
                at += 1
    while at < LINES and r.at < end:
        four = r.word(QUAD_CODES[s["quad"]])
        if r.at > end:
            break
        for j in range(4):
            if four >> (3 - j) & 1:
                out[at + j] = -1 if r.read(1) else 1
        at += 4
    return out[:LINES]


def requantised(lines: np.ndarray, s: dict, factors: np.ndarray, widths: np.ndarray, long: int) -> np.ndarray:
    """Lines to the power of 4/3, times the gains of their bands."""
    n = len(widths)
    own = factors[:n].astype(float)
    if s["pre"] and s["kind"] != SHORT:
        own[11:21] += PRETAB
    power = np.full(n, (s["gain"] - 210) / 4) - own * (1.0 if s["scale"] else 0.5)
    if s["kind"] == SHORT:
        power[long:] -= 2.0 * np.resize(s["sub"], n - long)
    return np.sign(lines) * np.abs(lines).astype(float) ** (4 / 3) * np.repeat(2.0**power, widths)


def _intensity(left: np.ndarray, right: np.ndarray, position: np.ndarray, illegal: np.ndarray, widths: np.ndarray, long: int, first: bool, scale: int, middle: bool) -> None:
    """Stereo above the last band in which the right channel has anything: the left channel is dealt to both by each band's position."""
    begins, n = np.cumsum(widths) - widths, len(widths)
    blocks = 3 if n > long else 1
    filled = np.array([right[a : a + w].any() for a, w in zip(begins, widths)])
    last = [max((i for i in np.flatnonzero(filled) if blocks == 1 or i < long or (i - long) % 3 == b), default=-1) for b in range(blocks)]
    if long:
        last = [max(last)] * blocks
    position, illegal = position[:n].copy(), illegal[:n].copy()
    for b in range(blocks):  # the highest band isn't coded: it follows the one before
        top = n - blocks + b
        known = last[b] < top - blocks
        position[top], illegal[top] = (position[top - blocks], illegal[top - blocks]) if known else (3 if first else 0, False)
    for i, (a, w) in enumerate(zip(begins, widths)):
        part = slice(a, a + w)
        after = last[(i - long) % 3 if blocks == 3 and i >= long else 0]
        if i > after and not (illegal[i] or first and position[i] >= 7):
            if first:
                ratio = np.tan(position[i] * np.pi / 12)
                kl, kr = (1.0, 0.0) if position[i] == 6 else (ratio / (1 + ratio), 1 / (1 + ratio))
            else:
                step = 2.0 ** (-0.25 * (1 + scale) * ((position[i] + 1) // 2))
                kl, kr = (step, 1.0) if position[i] % 2 else (1.0, step)
            left[part], right[part] = left[part] * kl, left[part] * kr
        elif middle:
            left[part], right[part] = (left[part] + right[part]) / np.sqrt(2), (left[part] - right[part]) / np.sqrt(2)


@functools.cache
def _transforms() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windowed inverse transforms: (kind, 36, 18) of long blocks, (12, 6) of a short one; butterflies; the matrix of the synthesis."""
    i, k = np.arange(36)[:, None], np.arange(18)[None]
    long = np.cos(np.pi / 72 * (2 * i + 19) * (2 * k + 1))
    full, short = np.sin(np.pi / 36 * (np.arange(36) + 0.5)), np.sin(np.pi / 12 * (np.arange(12) + 0.5))
    start = np.concatenate([full[:18], np.ones(6), short[6:], np.zeros(6)])
    windows = np.stack([full, start, np.zeros(36), start[::-1]])
    i, k = np.arange(12)[:, None], np.arange(6)[None]
    small = np.cos(np.pi / 24 * (2 * i + 7) * (2 * k + 1)) * short[:, None]
    c = np.array(BUTTERFLY)
    i, k = np.arange(64)[:, None], np.arange(32)[None]
    return windows[:, :, None] * long, small, np.stack([1 / np.sqrt(1 + c * c), c / np.sqrt(1 + c * c)]), np.cos(np.pi / 64 * (16 + i) * (2 * k + 1))


def hybrid(lines: np.ndarray, kinds: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Subband samples (granules * 18, 32) of one channel: lines (granules, 576) in order of frequency, kinds of their blocks, and how many
    of the lowest subbands are long in a granule of short blocks."""
    long, small, (cs, ca), _ = _transforms()
    n = len(lines)
    x = lines.reshape(n, BANDS, 18).copy()
    band = np.arange(1, BANDS)
    joined = (kinds != SHORT)[:, None] | (band < splits[:, None])  # borders between long subbands
    for i in range(8):
        up, down = x[:, 1:, i].copy(), x[:, :-1, 17 - i].copy()
        x[:, 1:, i] = np.where(joined, up * cs[i] + down * ca[i], up)
        x[:, :-1, 17 - i] = np.where(joined, down * cs[i] - up * ca[i], down)
    out = np.zeros((n, BANDS, 36))
    is_short = (kinds == SHORT)[:, None] & (np.arange(BANDS) >= splits[:, None])
    for kind in (LONG, START, STOP):
        own = ~is_short & (np.where(kinds == SHORT, LONG, kinds) == kind)[:, None]
        out[own] = x[own] @ long[kind].T
    if is_short.any():
        part = x[is_short].reshape(-1, 6, 3).transpose(0, 2, 1) @ small.T  # lines of the three blocks lie by turns
        whole = np.zeros((len(part), 36))
        for block in range(3):
            whole[:, 6 + 6 * block : 18 + 6 * block] += part[:, block]
        out[is_short] = whole
    summed = out[:, :, :18]
    summed[1:] += out[:-1, :, 18:]
    summed = summed.transpose(0, 2, 1).copy()
    summed[:, 1::2, 1::2] *= -1
    return summed.reshape(-1, BANDS)


def synthesis(subbands: np.ndarray, window: np.ndarray | None) -> np.ndarray:
    """Samples of subband samples (n, 32): each 32 come from the last 16 matrixed vectors."""
    if not subbands.any():
        return np.zeros(subbands.size)
    if window is None:
        raise AudioError("mp3: the standard's synthesis window is needed; give its file as mp3_tables")
    n = len(subbands)
    v = np.zeros((n + 15, 64))
    v[15:] = subbands @ _transforms()[3].T
    d, out = window.reshape(16, 32), np.zeros((n, 32))
    for i in range(8):
        out += v[15 - 2 * i : 15 - 2 * i + n, :32] * d[2 * i] + v[14 - 2 * i : 14 - 2 * i + n, 32:] * d[2 * i + 1]
    return out.reshape(-1)


def by_frequency(lines: np.ndarray, widths: np.ndarray, long: int) -> np.ndarray:
    """Short bands hold one block after the other; after this their lines lie by turns."""
    out, at = lines.copy(), int(widths[:long].sum())
    for w in widths[long::3]:
        out[at : at + 3 * w] = lines[at : at + 3 * w].reshape(3, w).T.reshape(-1)
        at += 3 * w
    return out


class Stream:
    """Granules between two breaks of a stream, whose overlaps and synthesis go on without a seam."""

    def __init__(self, channels: int):
        self.reservoir, self.channels = b"", channels
        self.lines: list[list[np.ndarray]] = [[] for _ in range(channels)]
        self.kinds: list[list[int]] = [[] for _ in range(channels)]
        self.splits: list[list[int]] = [[] for _ in range(channels)]

    def samples(self, window: np.ndarray | None) -> np.ndarray:
        if not self.lines[0]:
            return np.zeros((0, self.channels))
        return np.stack([synthesis(hybrid(np.array(x), np.array(k), np.array(s)), window) for x, k, s in zip(self.lines, self.kinds, self.splits)], 1)

    def add(self, main: bytes, granules: list, rate: int, first: bool, extension: int, tables: Tables) -> int:
        """Take a frame's granules; the bits of main data that they have used."""
        r, middle, intensity = Bits(main), bool(extension & 2), bool(extension & 1)
        before = np.zeros((self.channels, 40), np.int64)
        for row in granules:
            spectra, factors, tops = [], [], []
            for c, s in enumerate(row):
                end = r.at + s["length"]
                widths, long = layout(rate, s, first)
                own, top = read_factors(r, s, first, intensity and c == 1, before[c])
                before[c] = own
                spectra.append(requantised(read_lines(r, s, widths, end, tables), s, own, widths, long))
                factors.append(own)
                tops.append(top)
                r.at = end
            if intensity and len(row) == 2:
                widths, long = layout(rate, row[0], first)
                _intensity(*spectra, factors[1], tops[1], widths, long, first, row[1]["compress"] & 1, middle)
            elif middle and len(row) == 2:
                spectra = [(spectra[0] + spectra[1]) / np.sqrt(2), (spectra[0] - spectra[1]) / np.sqrt(2)]
            for c, s in enumerate(row):
                widths, long = layout(rate, s, first)
                self.lines[c].append(by_frequency(spectra[c], widths, long) if s["kind"] == SHORT else spectra[c])
                self.kinds[c].append(s["kind"])
                self.splits[c].append(int(widths[:long].sum()) // 18 if s["kind"] == SHORT else BANDS)
        return r.at
