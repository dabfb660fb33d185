"""WAV and AIFF: reading, and writing WAV at once or block by block."""

from __future__ import annotations

import struct

import numpy as np

from ..model import MAX_CHANNELS, MAX_CHUNK, MAX_RATE, ArgumentError, AudioError, check_shape

#: Encodings of the RIFF format chunk.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
WAVE_HEAD = 44


def from_codes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Signed codes to samples."""
    return (codes.astype(np.float64) / (1 << (bits - 1))).astype(np.float32)


def quantise(samples: np.ndarray, bits: int) -> np.ndarray:
    """Nearest codes, halves away from zero, clamped."""
    scale = 1 << (bits - 1)
    scaled = (samples.astype(np.float32) * np.float32(scale)).astype(np.float64)
    near = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
    return np.clip(np.nan_to_num(near), -scale, scale - 1).astype(np.int64)


def unpack(raw: bytes, bits: int, big: bool, unsigned8: bool) -> np.ndarray:
    """Signed codes of whole samples of 8, 16, 24 or 32 bits."""
    width = bits // 8
    raw = raw[: len(raw) // width * width]
    if bits == 8:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128 if unsigned8 else np.frombuffer(raw, np.int8).astype(np.int64)
    if bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        low, mid, high = (parts[:, i] for i in ((2, 1, 0) if big else (0, 1, 2)))
        codes = low | mid << 8 | high << 16
        return np.where(codes >= 1 << 23, codes - (1 << 24), codes)
    if bits in (16, 32):
        return np.frombuffer(raw, f"{'>' if big else '<'}i{width}").astype(np.int64)
    raise AudioError(f"unsupported bit depth: {bits}")


def pack(codes: np.ndarray, bits: int) -> bytes:
    """Little-endian signed codes of 16 or 24 bits."""
    if bits == 16:
        return codes.astype("<i2").tobytes()
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def chunks(data: bytes, big: bool, kind: str, strict: bool):
    """(id, where the body starts, declared size) after the 12-byte head. strict: a cut head that isn't zeros is an error."""
    at = 12
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8:
            if strict and head.strip(b"\0"):
                raise AudioError(f"{kind}: truncated chunk header")
            return
        size = int.from_bytes(head[4:], "big" if big else "little")
        if size > MAX_CHUNK:
            raise AudioError(f"{kind}: chunk exceeds the safety limit")
        yield head[:4], at + 8, size
        at += 8 + size + (size & 1)


def wave_format(data: bytes, at: int, size: int) -> tuple[int, int, int, int]:
    """Encoding, channels, rate and bits of a format chunk."""
    if size < 16 or at + 16 > len(data):
        raise AudioError("wav: fmt chunk is too short")
    encoding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
    if encoding == EXTENSIBLE and size >= 40 and at + 26 <= len(data):
        (encoding,) = struct.unpack_from("<H", data, at + 24)
    if not 1 <= channels <= MAX_CHANNELS:
        raise AudioError(f"wav: channel count out of range: {channels}")
    if not 1 <= rate <= MAX_RATE:
        raise AudioError(f"wav: sample rate out of range: {rate}")
    return encoding, channels, rate, bits


def read_wave(data: bytes) -> tuple[int, int, np.ndarray]:
    """rate, channels, interleaved samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("wav: missing RIFF or WAVE")
    form = raw = None
    for name, at, size in chunks(data, False, "wav", True):
        if name == b"fmt ":
            form = wave_format(data, at, size)
        elif name == b"data":
            raw = data[at : at + size]
            if len(raw) < size:
                raise AudioError("wav: data chunk is truncated")
    if form is None or raw is None:
        raise AudioError("wav: no fmt chunk" if form is None else "wav: no data chunk")
    encoding, channels, rate, bits = form
    if bits <= 0 or bits % 8:
        raise AudioError("wav: bit depth is not a whole byte count")
    if encoding == PCM and bits in (8, 16, 24, 32):
        samples = from_codes(unpack(raw, bits, False, True), bits)
    elif encoding == FLOAT and bits in (32, 64):
        samples = np.frombuffer(raw[: len(raw) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(np.float32)
    else:
        raise AudioError(f"wav: unsupported encoding or depth: {encoding}, {bits}")
    return rate, channels, samples[: len(samples) // channels * channels]


def wave_head(rate: int, channels: int, bits: int, n_bytes: int) -> bytes:
    block = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + n_bytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, channels, rate, rate * block, block, bits) + b"data" + struct.pack("<I", n_bytes)


def check_wave(rate: int, channels: int, bits: int) -> None:
    check_shape(rate, channels)
    if bits not in (16, 24):
        raise ArgumentError(f"wav: only 16 and 24 bits are written, not {bits}")


def write_wave(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    check_wave(rate, channels, bits)
    if len(samples) % channels:
        raise ArgumentError("wav: partial frame")
    if len(samples) * (bits // 8) > 0xFFFFFFFF - WAVE_HEAD:
        raise ArgumentError("wav: too large")
    body = pack(quantise(np.asarray(samples, np.float32), bits), bits)
    return wave_head(rate, channels, bits, len(body)) + body


class WaveWriter:
    """Writes a WAV block by block to a seekable binary file; sizes are set when it is closed."""

    def __init__(self, file, rate: int, channels: int, bits: int = 16):
        check_wave(rate, channels, bits)
        self.file, self.rate, self.channels, self.bits, self.values, self.closed = file, rate, channels, bits, 0, False
        file.write(wave_head(rate, channels, bits, 0))

    @property
    def frames(self) -> int:
        return self.values // self.channels

    def write(self, samples: np.ndarray) -> None:
        """Append whole frames."""
        if self.closed:
            raise ArgumentError("wav: the writer is closed")
        if len(samples) % self.channels:
            raise ArgumentError("wav: partial frame")
        if (self.values + len(samples)) * (self.bits // 8) > 0xFFFFFFFF - WAVE_HEAD:
            raise ArgumentError("wav: too large")
        self.file.write(pack(quantise(np.asarray(samples, np.float32), self.bits), self.bits))
        self.values += len(samples)

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.file.seek(0)
            self.file.write(wave_head(self.rate, self.channels, self.bits, self.values * (self.bits // 8)))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def extended80(raw: bytes) -> float:
    """An 80-bit float, as AIFF has its rate."""
    sign_exponent, mantissa = struct.unpack(">HQ", raw)
    if sign_exponent & 0x7FFF == 0 and mantissa == 0:
        return 0.0
    if sign_exponent & 0x7FFF == 0x7FFF:
        raise AudioError("aiff: sample rate is infinity or NaN")
    shift = (sign_exponent & 0x7FFF) - 16383 - 63
    if shift > 64:
        raise AudioError("aiff: sample rate out of range")
    value = (-1.0 if sign_exponent & 0x8000 else 1.0) * mantissa * 2.0**shift
    if not 0 <= value <= MAX_RATE:
        raise AudioError("aiff: sample rate out of range")
    return value


#: Uncompressed AIFF-C types.
AIFC_BIG, AIFC_LITTLE, AIFC_FLOAT = (b"NONE", b"twos"), (b"sowt",), (b"fl32", b"FL32")


def aiff_common(data: bytes, at: int, size: int) -> tuple[int, int, int, int, bytes]:
    """channels, frames, bits, rate and compression type of a COMM chunk."""
    if size < 18 or at + 18 > len(data):
        raise AudioError("aiff: COMM chunk is too short")
    channels, frames, bits = struct.unpack_from(">HIH", data, at)
    rate = int(extended80(data[at + 8 : at + 18]))
    kind = data[at + 18 : at + 22] if data[8:12] == b"AIFC" and size >= 22 else b"NONE"
    if kind not in AIFC_BIG + AIFC_LITTLE + AIFC_FLOAT:
        raise AudioError(f"aiff: compressed AIFF-C is not decoded: {kind.decode('latin-1')}")
    return channels, frames, bits, rate, kind


def read_aiff(data: bytes) -> tuple[int, int, np.ndarray]:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise AudioError("aiff: not AIFF or AIFC")
    common = raw = None
    for name, at, size in chunks(data, True, "aiff", False):
        if name == b"COMM":
            common = aiff_common(data, at, size)
        elif name == b"SSND":
            if size < 8 or at + 8 > len(data):
                raise AudioError("aiff: SSND chunk is too short")
            (offset,) = struct.unpack_from(">I", data, at)
            if offset > size - 8:
                raise AudioError("aiff: SSND offset is past the data")
            raw = data[at + 8 + offset : at + size]
            if len(raw) < size - 8 - offset:
                raise AudioError("aiff: sound data is truncated")
    if common is None or raw is None:
        raise AudioError("aiff: no COMM chunk" if common is None else "aiff: no SSND chunk")
    channels, frames, bits, rate, kind = common
    if not 1 <= channels <= MAX_CHANNELS or not 1 <= rate <= MAX_RATE:
        raise AudioError(f"aiff: channel count or sample rate out of range: {channels}, {rate}")
    if bits <= 0 or bits % 8:
        raise AudioError("aiff: bit depth is not a whole byte count")
    if kind in AIFC_FLOAT:
        samples = np.frombuffer(raw[: len(raw) // 4 * 4], ">f4").astype(np.float32)
    else:
        samples = from_codes(unpack(raw, bits, kind not in AIFC_LITTLE, False), bits)
    usable = min(frames, len(samples) // channels)
    return rate, channels, samples[: usable * channels]


def write_aiff(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """A plain AIFF, for tests and queries: the model only reads this format."""
    check_shape(rate, channels)
    codes = quantise(np.asarray(samples, np.float32), bits)
    body = np.ascontiguousarray(codes.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :]).tobytes() if bits > 8 else codes.astype(np.int8).tobytes()
    exponent = rate.bit_length() - 1
    rate80 = struct.pack(">HQ", 16383 + exponent, rate << (63 - exponent))
    if bits == 32:
        body = codes.astype(">i4").tobytes()
    common = b"COMM" + struct.pack(">IHIH", 18, channels, len(samples) // channels, bits) + rate80
    sound = b"SSND" + struct.pack(">III", 8 + len(body), 0, 0) + body + b"\0" * (len(body) & 1)
    return b"FORM" + struct.pack(">I", 4 + len(common) + len(sound)) + b"AIFF" + common + sound
