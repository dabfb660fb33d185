"""ALAC in MP4: a decoder and an encoder, after the public description of the format.

Samples are coded per frame: channels are mixed, an adaptive sign-driven filter predicts each sample from those before, and the errors are
written by an adaptive Golomb code with a mode for runs of zeros. The filter and the code depend on each sample before, so a frame
is sequential; frames carry their own coefficients, so they are independent of each other, and many are decoded side by side (alac_lanes)."""

from __future__ import annotations

import struct
import sys

import numpy as np

from ..model import MAX_RATE, ArgumentError, AudioError, check_shape
from . import alac_lanes as lanes
from . import mp4
from .bits import BitReader, BitWriter
from .pcm_files import from_codes, quantise

#: The adaptive code's scale, limits and escape width.
SCALE_BITS, ZERO_SHIFT, ZERO_ROUND_BITS, ZERO_OFFSET = 9, 2, 6, 24
MAX_PREFIX, RUN_BITS, MEAN_LIMIT = 9, 16, 0xFFFF
#: The encoder's parameters: first coefficients (sixteenths), their scale, channel weights' scale and count, taps, code parameters.
SEED, FILTER_SHIFT, MIX_BITS, MIX_MOST, TAPS = (38, -29, -2), 9, 2, 4, 8
PB, MB, KB, MAX_RUN, FRAME = 40, 10, 14, 255, 4096
#: Element tags.
SINGLE, PAIR, LFE, END = 0, 1, 3, 7
MAX_FRAME, MAX_TAPS = 1 << 20, 32


def parse_cookie(raw: bytes) -> dict:
    """The decoder's parameters; a full box's version and flags may stand before them."""
    if len(raw) >= 28 and raw[:4] == bytes(4):
        raw = raw[4:]
    if len(raw) < 24:
        raise AudioError("alac: magic cookie is too short")
    length, _, bits, pb, mb, kb, channels, run, _, _, rate = struct.unpack_from(">IBBBBBBHIII", raw)
    if not 1 <= length <= MAX_FRAME or bits not in (16, 20, 24, 32) or channels not in (1, 2):
        raise AudioError(f"alac: unsupported shape: {length} samples a frame, {bits} bits, {channels} channels")
    return {"length": length, "bits": bits, "pb": pb, "mb": mb, "kb": kb, "channels": channels, "run": run, "rate": rate}


def _leading(x: int) -> int:
    """Zeros above a 32-bit number's highest one."""
    return 32 - x.bit_length()


class _Window:
    """The bits of a frame: a slice of its bytes is kept as one number, so that each read costs the same in long frames."""

    STEP = 64

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data + bytes(self.STEP + 8), len(data) * 8, 0
        self._load()

    def _load(self) -> None:
        self.base = self.at >> 3
        self.value = int.from_bytes(self.data[self.base : self.base + self.STEP + 8], "big")

    def _bits(self, n: int) -> int:
        if self.at - 8 * self.base > 8 * self.STEP - 64:
            self._load()
        return self.value >> (8 * (self.STEP + 8) - (self.at - 8 * self.base) - n) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise AudioError("alac: past the end of a frame")
        value = self._bits(n)
        self.at += n
        return value

    def peek32(self) -> int:
        """The next 32 bits; beyond the end zeros follow."""
        if self.at > self.size:
            raise AudioError("alac: past the end of a frame")
        return self._bits(32)


def _golomb(r: _Window, k: int, m: int, escape: int) -> int:
    word = r.peek32()
    ones = _leading(~word & 0xFFFFFFFF)
    if ones >= MAX_PREFIX:
        r.read(MAX_PREFIX)
        return r.read(escape)
    r.read(ones + 1)
    low = r.peek32() >> (32 - k)
    if low < 2:
        r.read(k - 1)
        return ones * m
    r.read(k)
    return ones * m + low - 1


def decode_errors(r: _Window, n: int, bits: int, pb: int, mb: int, kb: int) -> list[int]:
    """Prediction errors by the adaptive code: the mean of what was read sets the next code's parameter."""
    out: list[int] = []
    mean, zero, mask = mb, 0, (1 << kb) - 1
    while len(out) < n:
        k = min(31 - _leading((mean >> SCALE_BITS) + 3), kb)
        code = _golomb(r, k, (1 << k) - 1, bits)
        signed = code + zero
        out.append(-((signed + 1) >> 1) if signed & 1 else signed >> 1)
        mean = MEAN_LIMIT if code > MEAN_LIMIT else pb * signed + mean - (pb * mean >> SCALE_BITS)
        zero = 0
        if mean << ZERO_SHIFT < 1 << SCALE_BITS and len(out) < n:
            k = _leading(mean) - ZERO_OFFSET + ((mean + (1 << (ZERO_ROUND_BITS - 2))) >> ZERO_ROUND_BITS)
            run = _golomb(r, k, ((1 << k) - 1) & mask, RUN_BITS)
            if len(out) + run > n:
                raise AudioError("alac: a run of zeros is too long")
            out += [0] * run
            zero, mean = 0 if run >= MEAN_LIMIT else 1, 0
    return out


def _put_golomb(w: list, k: int, m: int, value: int, escape: int) -> None:
    """As (value, bits) pairs."""
    ones, rest = divmod(value, m)
    if ones >= MAX_PREFIX:
        w.append(((1 << MAX_PREFIX) - 1, MAX_PREFIX))
        w.append((value, escape))
        return
    w.append((((1 << ones) - 1) << 1, ones + 1))
    w.append((rest + 1, k) if rest else (0, k - 1))


def encode_errors(errors: list[int], bits: int, pb: int = PB, mb: int = MB, kb: int = KB) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    mean, zero, mask, i, n = mb, 0, (1 << kb) - 1, 0, len(errors)
    while i < n:
        k = min(31 - _leading((mean >> SCALE_BITS) + 3), kb)
        e = errors[i]
        i += 1
        signed = 2 * e if e >= 0 else -2 * e - 1
        code = signed - zero
        _put_golomb(out, k, (1 << k) - 1, code, bits)
        mean = MEAN_LIMIT if code > MEAN_LIMIT else pb * signed + mean - (pb * mean >> SCALE_BITS)
        zero = 0
        if mean << ZERO_SHIFT < 1 << SCALE_BITS and i < n:
            run = 0
            while i < n and errors[i] == 0 and run < MEAN_LIMIT:
                run, i = run + 1, i + 1
            k = _leading(mean) - ZERO_OFFSET + ((mean + (1 << (ZERO_ROUND_BITS - 2))) >> ZERO_ROUND_BITS)
            _put_golomb(out, k, ((1 << k) - 1) & mask, run, RUN_BITS)
            zero, mean = 0 if run >= MEAN_LIMIT else 1, 0
    return out


def _wrap(x: int, bits: int) -> int:
    half = 1 << (bits - 1)
    return ((x + half) & ((1 << bits) - 1)) - half


def _adapt(taps: list[int], history: list[int], top: int, error: int, shift: int) -> None:
    """Move each tap towards what would have made the error smaller, oldest sample first, until the error is spent."""
    sign, n = (1 if error > 0 else -1), len(taps)
    left = abs(error)
    for k in range(n - 1, -1, -1):
        d = top - history[-1 - k]
        s = (d > 0) - (d < 0)
        taps[k] = _wrap(taps[k] - sign * s, 16)
        # The format shifts toward minus infinity, so the share's sign matters.
        share = sign * s * d >> shift
        left -= (n - k) * share * sign
        if left <= 0:
            return


def filter_block(values: list[int], taps: list[int], bits: int, shift: int, undo: bool) -> list[int]:
    """Errors to samples (undo) or samples to errors. No taps: a copy. 31 taps' worth (as the format has it): plain differences."""
    n = len(taps)
    if not n or not values:
        return list(values)
    samples, out = [values[0]], [values[0]]
    for j in range(1, len(values)):
        if j <= n:
            predicted = samples[-1]
            top = 0
            history = None
        else:
            top, history = samples[j - n - 1], samples
            total = sum(taps[k] * (samples[-1 - k] - top) for k in range(n))
            predicted = top + ((total + (1 << (shift - 1))) >> shift)
        if undo:
            error = values[j]
            sample = _wrap(predicted + error, bits)
            out.append(sample)
        else:
            sample = values[j]
            error = _wrap(sample - predicted, bits)
            out.append(error)
        if history is not None and error:
            _adapt(taps, samples, top, error, shift)
        samples.append(sample)
    return out


def sums(errors: list[int], bits: int) -> list[int]:
    out = list(errors)
    for j in range(1, len(out)):
        out[j] = _wrap(out[j] + out[j - 1], bits)
    return out


def decode_frame(data: bytes, c: dict) -> np.ndarray:
    """One coded frame: channels in rows."""
    r, planes = _Window(data), []
    while len(planes) < c["channels"]:
        tag = r.read(3)
        if tag == END:
            break
        if tag not in (SINGLE, PAIR, LFE):
            raise AudioError(f"alac: element {tag} is not decoded")
        count = 2 if tag == PAIR else 1
        if len(planes) + count > c["channels"] or (count == 1 and c["channels"] == 2):
            raise AudioError("alac: elements don't match the channel count")
        planes += _element(r, c, count)
    if len(planes) != c["channels"]:
        raise AudioError("alac: a channel is missing")
    return np.array(planes, np.int64)


def _element(r: _Window, c: dict, count: int) -> list[list[int]]:
    r.read(4)
    if r.read(12):
        raise AudioError("alac: reserved bits are set")
    partial, shifted, escape = r.read(1), r.read(2), r.read(1)
    if shifted == 3:
        raise AudioError("alac: bad shift")
    n = r.read(32) if partial else c["length"]
    if n > c["length"]:
        raise AudioError("alac: a frame is too long")
    bits = c["bits"]
    if escape:
        flat = [_wrap(r.read(bits), bits) for _ in range(n * count)]
        return [flat[i::count] for i in range(count)]
    width, low = bits - 8 * shifted + (count - 1), []
    mix_bits, mix = r.read(8), _wrap(r.read(8), 8)
    heads = []
    for _ in range(count):
        mode, shift, factor, taps = r.read(4), r.read(4), r.read(3), r.read(5)
        if taps > MAX_TAPS:
            raise AudioError("alac: too many coefficients")
        heads.append((mode, shift, factor, [_wrap(r.read(16), 16) for _ in range(taps)]))
    if shifted:
        low = [r.read(8 * shifted) for _ in range(n * count)]
    planes = []
    for mode, shift, factor, taps in heads:
        errors = decode_errors(r, n, width, c["pb"] * factor // 4, c["mb"], c["kb"])
        if mode:
            errors = sums(errors, width)
        planes.append(sums(errors, width) if len(taps) == 31 else filter_block(errors, taps, width, max(shift, 1), True))
    if count == 2:
        u, v = planes
        if mix:
            left = [a + b - (mix * b >> mix_bits) for a, b in zip(u, v)]
            planes = [left, [x - b for x, b in zip(left, v)]]
    if shifted:
        planes = [[x << 8 * shifted | y for x, y in zip(p, low[i::count])] for i, p in enumerate(planes)]
    return planes


def _head(data: bytes, c: dict) -> dict | None:
    """What stands before the codes of a frame that is one plain element; None for any other, which is decoded by itself."""
    r = _Window(data)
    count = {SINGLE: 1, LFE: 1, PAIR: 2}.get(r.read(3))
    r.read(4)
    if count != c["channels"] or r.read(12):
        return None
    partial, shifted, escape = r.read(1), r.read(2), r.read(1)
    if escape or shifted == 3:
        return None
    n = r.read(32) if partial else c["length"]
    if not 0 < n <= c["length"]:
        return None
    head = {"n": n, "shifted": shifted, "width": c["bits"] - 8 * shifted + count - 1, "mix_bits": r.read(8), "mix": _wrap(r.read(8), 8), "planes": []}
    for _ in range(count):
        mode, shift, factor, taps = r.read(4), r.read(4), r.read(3), r.read(5)
        head["planes"].append((mode, max(shift, 1), factor, [_wrap(r.read(16), 16) for _ in range(taps)]))
        if mode or not 0 < taps < 31:
            return None
    head["low"] = [r.read(8 * shifted) for _ in range(n * count)] if shifted else []
    return head | {"at": r.at}


def _side_by_side(frames: list[tuple[bytes, dict]]) -> list[np.ndarray | None]:
    """decode_frame() of frames (bytes and parameters) all at once; None where a frame has to be decoded by itself."""
    out: list = [None] * len(frames)
    heads = []
    for i, (data, c) in enumerate(frames):
        try:
            if head := _head(data, c):
                heads.append((i, c, head))
        except AudioError:
            pass
    if len(heads) < lanes.ENOUGH:
        return out
    words = lanes.Words([frames[i][0] for i, _, _ in heads])
    at, n = words.begin + [h["at"] for _, _, h in heads], np.array([h["n"] for _, _, h in heads])
    width, bad, planes = np.array([h["width"] for _, _, h in heads]), np.zeros(len(heads), bool), {}
    for channel in range(2):
        own = np.array([j for j, (_, _, h) in enumerate(heads) if channel < len(h["planes"])], np.int64)
        if not len(own):
            break
        specs = [heads[j][2]["planes"][channel] for j in own]
        numbers = lambda name, own=own: np.array([heads[j][1][name] for j in own], np.int64)
        pb = numbers("pb") * np.array([s[2] for s in specs]) // 4
        errors, at[own], lost = lanes.decode_errors(words, own, at[own], n[own], width[own], pb, numbers("mb"), numbers("kb"), sys.modules[__name__])
        bad[own] |= lost
        alike: dict = {}
        for place, (_, shift, _, taps) in enumerate(specs):
            alike.setdefault((shift, len(taps)), []).append(place)
        for (shift, _), places in alike.items():
            longest = int(n[own[places]].max())
            samples = lanes.undo_filter(errors[places, :longest], np.array([specs[p][3] for p in places], np.int64), width[own[places]], shift)
            for place, row in zip(places, samples):
                planes[own[place], channel] = row
    for j, (i, c, h) in enumerate(heads):
        if bad[j]:
            continue
        own = [planes[j, channel][: h["n"]] for channel in range(c["channels"])]
        if len(own) == 2 and h["mix"]:
            u, v = own
            left = u + v - (h["mix"] * v >> h["mix_bits"])
            own = [left, left - v]
        if h["shifted"]:
            own = [p << 8 * h["shifted"] | np.array(h["low"][k :: c["channels"]], np.int64) for k, p in enumerate(own)]
        out[i] = np.stack(own)
    return out


def _opened(data: bytes) -> tuple[dict, dict, list[bytes]]:
    track = mp4.audio_track(data)
    if track["codec"] != "alac":
        raise AudioError(f"mp4: the audio track is {track['codec']}, which is not decoded")
    return track, parse_cookie(track["setup"]), [mp4.sample_data(data, s) for s in track["samples"]]


def read_many(files: list[bytes]) -> list:
    """read_alac() of several files, whose frames are decoded side by side; an AudioError in place of a file that can't be decoded."""
    opened: list = []
    for data in files:
        try:
            opened.append(_opened(data))
        except (AudioError, IndexError, ValueError, struct.error) as e:
            opened.append(e if isinstance(e, AudioError) else AudioError(f"malformed: {e}"))
    frames = [(raw, o[1]) for o in opened if not isinstance(o, AudioError) for raw in o[2]]
    found, out = iter(_side_by_side(frames)), []
    for o in opened:
        if isinstance(o, AudioError):
            out.append(o)
            continue
        own = [(raw, next(found)) for raw in o[2]]
        try:
            out.append(_joined(o[0], o[1], [decode_frame(raw, o[1]) if block is None else block for raw, block in own]))
        except (AudioError, IndexError, ValueError, struct.error) as e:
            out.append(e if isinstance(e, AudioError) else AudioError(f"malformed: {e}"))
    return out


def _joined(track: dict, c: dict, blocks: list[np.ndarray]) -> tuple[int, int, np.ndarray]:
    planes = np.concatenate(blocks, 1) if blocks else np.zeros((c["channels"], 0), np.int64)
    rate = c["rate"] if 1 <= c["rate"] <= MAX_RATE else track["rate"]
    return rate, c["channels"], from_codes(planes.T.reshape(-1), c["bits"])


def read_alac(data: bytes) -> tuple[int, int, np.ndarray]:
    track, c, frames = _opened(data)
    found = _side_by_side([(raw, c) for raw in frames])
    return _joined(track, c, [decode_frame(raw, c) if block is None else block for raw, block in zip(frames, found)])


# --- writing ----------------------------------------------------------------


def seed_taps() -> list[int]:
    return [s * (1 << FILTER_SHIFT) >> 4 for s in SEED] + [0] * (TAPS - len(SEED))


def mix_channels(left: list[int], right: list[int], weight: int) -> tuple[list[int], list[int]]:
    """A weighted mean and the difference; weight 0 leaves the channels as they are."""
    if not weight:
        return left, right
    keep = (1 << MIX_BITS) - weight
    return [(weight * a + keep * b) >> MIX_BITS for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]


def _coded(planes: list[list[int]], width: int) -> list[list[tuple[int, int]]]:
    return [encode_errors(filter_block(p, seed_taps(), width, FILTER_SHIFT, False), width) for p in planes]


def encode_frame(planes: list[list[int]], bits: int, length: int) -> bytes:
    n, count = len(planes[0]), len(planes)
    shifted = 1 if bits == 24 else 0
    width = bits - 8 * shifted + (count - 1)
    high = [[x >> 8 * shifted for x in p] for p in planes]
    weight = 0
    if count == 2:  # the weight that codes an eighth of the frame in the fewest bits
        some = max(1, n // 8)
        sizes = [sum(b for part in _coded(list(mix_channels(high[0][:some], high[1][:some], m)), width) for _, b in part) for m in range(MIX_MOST + 1)]
        weight = int(np.argmin(sizes))
        high = list(mix_channels(high[0], high[1], weight))
    coded = _coded(high, width)
    w = BitWriter()
    w.put(PAIR if count == 2 else SINGLE, 3)
    w.put(0, 16)
    head = 8 * 2 + count * (16 + 16 * TAPS) + shifted * 8 * n * count
    escape = head + sum(b for part in coded for _, b in part) >= n * count * bits
    w.put(int(n != length), 1)
    w.put(0 if escape else shifted, 2)
    w.put(int(escape), 1)
    if n != length:
        w.put(n, 32)
    if escape:
        w.put_many(np.array(planes, np.int64).T.reshape(-1), bits)
    else:
        w.put(MIX_BITS, 8)
        w.put_signed(weight, 8)
        for _ in range(count):
            w.put(FILTER_SHIFT, 8)
            w.put(4 << 5 | TAPS, 8)
            for t in seed_taps():
                w.put_signed(t, 16)
        if shifted:
            w.put_many(np.array(planes, np.int64).T.reshape(-1) & 0xFF, 8)
        for part in coded:
            _put_all(w, part)
    w.put(END, 3)
    w.align()
    return w.to_bytes()


def _put_all(w: BitWriter, pairs: list[tuple[int, int]]) -> None:
    """Many short values: built as text, once."""
    digits = "".join(format(v, f"0{b}b") for v, b in pairs if b)
    w.put_bits(np.frombuffer(digits.encode(), np.uint8) - 48)


def cookie(bits: int, channels: int, rate: int, largest: int, average: int) -> bytes:
    return struct.pack(">IBBBBBBHIII", FRAME, 0, bits, PB, MB, KB, channels, MAX_RUN, largest, average, rate)


def write_alac(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """Interleaved samples as ALAC in an M4A file."""
    check_shape(rate, channels)
    if bits not in (16, 24) or channels > 2:
        raise ArgumentError(f"alac: 16 or 24 bits and one or two channels are written, not {bits} and {channels}")
    if not len(samples) or len(samples) % channels:
        raise ArgumentError("alac: at least one whole frame is needed")
    planes = quantise(np.asarray(samples, np.float32), bits).reshape(-1, channels).T
    total = planes.shape[1]
    frames = [encode_frame([p.tolist() for p in planes[:, at : at + FRAME]], bits, FRAME) for at in range(0, total, FRAME)]
    average = int(sum(map(len, frames)) * 8 * rate / total)
    setup = mp4.full(b"alac", cookie(bits, channels, rate, max(map(len, frames)), average))
    return mp4.write_track(b"alac", setup, rate, channels, bits, frames, FRAME, total)
