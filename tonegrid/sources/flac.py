"""FLAC: a decoder for all of the subset's subframe kinds, and an encoder with fixed predictors."""

from __future__ import annotations

import hashlib

import numpy as np

from ..model import MAX_RATE, ArgumentError, AudioError, check_shape
from .bits import BitReader, BitWriter, crc, rice_bits
from .pcm_files import from_codes, quantise

BLOCK = 4096
#: Fixed values of the format: rates and depths by code.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
MAX_FRAMES = 1 << 30


def stream_info(data: bytes) -> dict:
    """The STREAMINFO fields, where the frames begin, and all metadata blocks (kind, start, size)."""
    if data[:4] != b"fLaC":
        raise AudioError("flac: missing fLaC")
    at, info, blocks = 4, None, []
    while True:
        if at + 4 > len(data):
            raise AudioError("flac: metadata is truncated")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4
        if at + size > len(data):
            raise AudioError("flac: metadata is truncated")
        blocks.append((kind, at, size))
        if kind == 0 and info is None:
            info = _parse_info(data[at : at + size])
        at += size
        if last:
            break
    if info is None:
        raise AudioError("flac: no STREAMINFO")
    return info | {"frames_at": at, "blocks": blocks}


def _parse_info(body: bytes) -> dict:
    if len(body) < 34:
        raise AudioError("flac: STREAMINFO is too short")
    packed = int.from_bytes(body[10:18], "big")
    rate, channels, bits, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    if not 1 <= rate <= MAX_RATE or not 4 <= bits <= 32:
        raise AudioError(f"flac: rate or depth out of range: {rate}, {bits}")
    if total > MAX_FRAMES:
        raise AudioError("flac: too many frames")
    smallest, largest = int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big")
    return {"rate": rate, "channels": channels, "bits": bits, "total": total, "min_block": smallest, "max_block": largest, "md5": body[18:34]}


def _coded_number(r: BitReader) -> int:
    """A number of up to 36 bits, written as UTF-8 writes characters."""
    first = r.read(8)
    if first < 0x80:
        return first
    extra = 8 - (first ^ 0xFF).bit_length() - 1
    if not 1 <= extra <= 6:
        raise AudioError("flac: bad frame number")
    value = first & ((1 << (6 - extra)) - 1)
    for _ in range(extra):
        byte = r.read(8)
        if byte >> 6 != 2:
            raise AudioError("flac: bad frame number")
        value = value << 6 | byte & 0x3F
    return value


def _residual(r: BitReader, n: int, order: int) -> np.ndarray:
    method = r.read(2)
    if method > 1:
        raise AudioError("flac: unknown residual coding")
    width = 4 + method
    parts = 1 << r.read(4)
    if n % parts or n // parts < order:
        raise AudioError("flac: bad partition order")
    out = []
    for p in range(parts):
        count = n // parts - (order if p == 0 else 0)
        k = r.read(width)
        if k == (1 << width) - 1:
            out.append(r.read_many(count, r.read(5)))
        else:
            codes = r.rice(count, k)
            out.append(codes >> 1 ^ -(codes & 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _restore_fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Sums undo differences: one cumulative sum per order, each begun from the differences of the first samples."""
    values = residual
    for order in range(len(warm) - 1, -1, -1):
        start = np.diff(warm, order)[-1]
        values = start + np.cumsum(values)
    return np.concatenate([warm, values])


def _restore_lpc(warm: np.ndarray, residual: np.ndarray, taps: list[int], shift: int) -> np.ndarray:
    out = warm.tolist()
    taps = taps[::-1]
    order = len(taps)
    for e in residual.tolist():
        out.append(e + (sum(t * x for t, x in zip(taps, out[-order:])) >> shift))
        if not -(1 << 40) < out[-1] < 1 << 40:
            raise AudioError("flac: prediction ran away")
    return np.array(out, np.int64)


def _subframe(r: BitReader, n: int, bits: int) -> np.ndarray:
    if r.read(1):
        raise AudioError("flac: subframe padding is not zero")
    kind, wasted = r.read(6), 0
    if r.read(1):
        wasted = r.unary() + 1
        bits -= wasted
        if bits < 1:
            raise AudioError("flac: all bits are wasted")
    if kind == 0:
        values = np.full(n, r.read_signed(bits), np.int64)
    elif kind == 1:
        values = r.read_many(n, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        if order > n:
            raise AudioError("flac: order beyond the block")
        warm = r.read_many(order, bits)
        values = _restore_fixed(warm, _residual(r, n, order))
    elif kind >= 32:
        order = kind - 31
        if order > n:
            raise AudioError("flac: order beyond the block")
        warm = r.read_many(order, bits)
        precision = r.read(4) + 1
        shift = r.read_signed(5)
        if precision == 16 or shift < 0:
            raise AudioError("flac: bad predictor")
        taps = r.read_many(order, precision).tolist()
        values = _restore_lpc(warm, _residual(r, n, order), taps, shift)
    else:
        raise AudioError(f"flac: reserved subframe kind {kind}")
    if len(values) and max(-int(values.min()) - 1, int(values.max())) >> max(bits, 1):
        raise AudioError("flac: samples exceed their width")
    return values << wasted


def _frame(r: BitReader, info: dict) -> np.ndarray:
    """One frame: channels in rows."""
    if r.read(14) != 0x3FFE:
        raise AudioError("flac: lost frame sync")
    r.read(2)
    size_code, rate_code, channel_code, depth_code = r.read(4), r.read(4), r.read(4), r.read(3)
    r.read(1)
    _coded_number(r)
    if size_code == 1:
        n = 192
    elif 2 <= size_code <= 5:
        n = 576 << (size_code - 2)
    elif size_code in (6, 7):
        n = r.read(8 if size_code == 6 else 16) + 1
    elif size_code >= 8:
        n = 256 << (size_code - 8)
    else:
        raise AudioError("flac: reserved block size")
    if rate_code == 12:
        r.read(8)
    elif rate_code in (13, 14):
        r.read(16)
    elif rate_code == 15:
        raise AudioError("flac: bad rate code")
    bits = DEPTHS.get(depth_code, info["bits"] if depth_code == 0 else None)
    if bits is None:
        raise AudioError("flac: reserved depth")
    if channel_code > MID_SIDE:
        raise AudioError("flac: reserved channel assignment")
    r.read(8)  # the header's check
    count = channel_code + 1 if channel_code < LEFT_SIDE else 2
    if count != info["channels"]:
        raise AudioError("flac: channel count changes")
    wide = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(channel_code)
    planes = [_subframe(r, n, bits + (c == wide)) for c in range(count)]
    if channel_code == LEFT_SIDE:
        planes[1] = planes[0] - planes[1]
    elif channel_code == SIDE_RIGHT:
        planes[0] = planes[0] + planes[1]
    elif channel_code == MID_SIDE:
        middle, side = planes
        both = middle << 1 | side & 1
        planes = [(both + side) >> 1, (both - side) >> 1]
    r.align()
    r.read(16)  # the frame's check
    return np.stack(planes)


def read_codes(data: bytes) -> tuple[dict, np.ndarray]:
    """STREAMINFO and integer samples, channels in rows."""
    info = stream_info(data)
    r, blocks, done = BitReader(data, info["frames_at"]), [], 0
    while r.left >= 32 and (not info["total"] or done < info["total"]):
        blocks.append(_frame(r, info))
        done += blocks[-1].shape[1]
        if done > MAX_FRAMES:
            raise AudioError("flac: too many frames")
    planes = np.concatenate(blocks, 1) if blocks else np.zeros((info["channels"], 0), np.int64)
    if info["total"]:
        planes = planes[:, : info["total"]]
    return info, planes


def read_flac(data: bytes) -> tuple[int, int, np.ndarray]:
    info, planes = read_codes(data)
    return info["rate"], info["channels"], from_codes(planes.T.reshape(-1), info["bits"])


# --- writing ----------------------------------------------------------------


def _put_number(w: BitWriter, value: int) -> None:
    if value < 0x80:
        w.put(value, 8)
        return
    extra = next(e for e in range(1, 7) if value < 1 << (5 * e + 6))
    w.put((0xFF << (7 - extra) & 0xFF) | value >> (6 * extra), 8)
    for e in range(extra - 1, -1, -1):
        w.put(0x80 | value >> (6 * e) & 0x3F, 8)


def plan_residuals(residuals: np.ndarray, bits: int) -> tuple[int, int, int, list[int]]:
    """Bits, order, partition order (0 to 6) and Rice parameters (0 to 14) of the cheapest coding; the smaller of equals. residuals has a
    row of n numbers for each order, with zeros in place of the first ones, so that partitions lie alike in all rows."""
    orders, n = residuals.shape
    codes = residuals << 1 ^ residuals >> 63
    most = next(p for p in range(6, -1, -1) if n % (1 << p) == 0)
    sums = np.empty((15, orders, 1 << most), np.int64)
    thin = codes.astype(np.int32) if codes.max(initial=0) < 1 << 31 else codes
    for k in range(15):
        sums[k] = thin.reshape(orders, 1 << most, -1).sum(2, dtype=np.int64)
        thin = thin >> 1
    k, order = np.arange(15)[:, None, None], np.arange(orders)
    best: tuple = (n * bits + 1, 0, 0, [])
    for p in range(most, -1, -1):
        counts = np.full((orders, 1 << p), n >> p)
        counts[:, 0] -= order
        costs = sums + counts * (1 + k) + 4
        totals = np.where(n >> p > order, costs.min(0).sum(1) + 6 + order * bits, np.iinfo(np.int64).max)
        own = int(totals.argmin())
        if totals[own] <= best[0]:
            found = int(totals[own]), own, p, costs[:, own].argmin(0).tolist()
            if found[0] < best[0] or own <= best[1]:
                best = found
        sums = sums[:, :, 0::2] + sums[:, :, 1::2] if p else sums
    return best


def _put_subframe(w: BitWriter, x: np.ndarray, bits: int) -> None:
    n = len(x)
    if n and (x == x[0]).all():
        w.put(0, 8)
        w.put_signed(int(x[0]), bits)
        return
    residuals = np.zeros((min(5, n), n), np.int64)
    for order in range(len(residuals)):
        residuals[order, order:] = np.diff(residuals[order - 1, order - 1 :]) if order else x
    cost, order, p, parameters = plan_residuals(residuals, bits)
    if cost >= n * bits:
        w.put(1 << 1, 8)
        w.put_many(x, bits)
        return
    w.put((8 + order) << 1, 8)
    w.put_many(x[:order], bits)
    w.put(0, 2)
    w.put(p, 4)
    own = residuals[order, order:]
    sizes = [n >> p] * (1 << p)
    sizes[0] -= order
    w.put_bits(rice_bits(own << 1 ^ own >> 63, sizes, parameters, 4))


def write_flac(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """Interleaved samples as FLAC: blocks of 4096, channels apart, fixed predictors."""
    check_shape(rate, channels)
    if bits not in (8, 16, 24):
        raise ArgumentError(f"flac: only 8, 16 and 24 bits are written, not {bits}")
    if channels > 8:
        raise ArgumentError(f"flac: at most 8 channels, not {channels}")
    if len(samples) % channels:
        raise ArgumentError("flac: partial frame")
    codes = quantise(np.asarray(samples, np.float32), bits)
    planes = codes.reshape(-1, channels).T
    frames = planes.shape[1]
    wide = codes.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8] if bits != 8 else codes.astype(np.int8).view(np.uint8)
    block = min(BLOCK, max(frames, 1))
    coded = []
    rate_code = next((c for c, r in RATES.items() if r == rate), None)
    for number, at in enumerate(range(0, frames, block)):
        part = planes[:, at : at + block]
        n, w = part.shape[1], BitWriter()
        w.put(0x3FFE << 2, 16)
        w.put(7, 4)
        w.put(rate_code if rate_code else (13 if rate < 65536 else 0), 4)
        w.put(channels - 1, 4)
        w.put(next(c for c, d in DEPTHS.items() if d == bits), 3)
        w.put(0, 1)
        _put_number(w, number)
        w.put(n - 1, 16)
        if not rate_code and rate < 65536:
            w.put(rate, 16)
        w.put(crc(w.to_bytes(), 8), 8)
        for plane in part:
            _put_subframe(w, plane, bits)
        w.align()
        body = w.to_bytes()
        coded.append(body + crc(body, 16).to_bytes(2, "big"))
    sizes = [len(c) for c in coded] or [0]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | frames).to_bytes(8, "big") + hashlib.md5(np.ascontiguousarray(wide).tobytes()).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(coded)
