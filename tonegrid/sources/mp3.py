"""MPEG audio frames: headers, spans, frame walks, and files decoded by layer 3."""

from __future__ import annotations

import numpy as np

from ..model import AudioError
from . import layer3
from .tags import ID3V1, syncsafe

#: Bit rates (kbit/s) by version 1 or 2, for layer 3; sample rates by version.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def header(data: bytes, at: int) -> dict | None:
    """The header of a layer 3 frame, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    rate_index, bit_index = data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if version == 1 or layer != 1 or rate_index == 3 or bit_index in (0, 15):
        return None
    rate, kbps = RATES[version][rate_index], BITRATES[1 if version == 3 else 2][bit_index]
    samples = 1152 if version == 3 else 576
    size = samples // 8 * kbps * 1000 // rate + (data[at + 2] >> 1 & 1)
    return {"version": version, "rate": rate, "kbps": kbps, "samples": samples, "size": size, "mode": data[at + 3] >> 6, "channels": 1 if data[at + 3] >> 6 == 3 else 2}


def coding(data: bytes, at: int) -> tuple[int, bool]:
    """Of a frame: how joint stereo is coded (1: intensity, 2: middle and side; 0 in any other mode), and whether a check follows the header."""
    return (data[at + 3] >> 4 & 3 if data[at + 3] >> 6 == 1 else 0), not data[at + 1] & 1


def span(data: bytes) -> tuple[int, int]:
    """Where audio begins and ends: tags at either end are left out."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at += 10 + syncsafe(data[at + 6 : at + 10])
    if data[end - ID3V1 : end - ID3V1 + 3] == b"TAG":
        end -= ID3V1
    foot = data[end - 32 : end]
    if foot[:8] == b"APETAGEX":
        end -= int.from_bytes(foot[12:16], "little") + (32 if foot[23] & 0x80 else 0)
    return min(at, len(data)), max(end, 0)


def _same(a: dict, b: dict) -> bool:
    return (a["version"], a["rate"], a["channels"]) == (b["version"], b["rate"], b["channels"])


def _next(data: bytes, at: int, end: int) -> int:
    """The next place from `at` on with a header that up to ten following ones agree with; -1 if there is none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        first = header(data, at)
        if first and _agrees(data, at, end, first):
            return at
        at += 1
    return -1


def frames(data: bytes) -> list[tuple[int, dict]]:
    """(offset, header) of the frames of one stream; bytes between frames are passed over."""
    at, end = span(data)
    at, out = _next(data, at, end), []
    while 0 <= at < end:
        h = header(data, at)
        if not h:
            at = _next(data, at, end)
            continue
        if at + h["size"] > end or out and not _same(out[0][1], h):
            break
        out.append((at, h))
        at += h["size"]
    return out


def _agrees(data: bytes, at: int, end: int, first: dict) -> bool:
    for _ in range(10):
        at += header(data, at)["size"]
        if at >= end:
            return True
        h = header(data, at)
        if not h or not _same(first, h):
            return False
    return True


def first_header(data: bytes) -> dict:
    at, end = span(data)
    while 0 <= (at := data.find(b"\xff", at, end)):
        if h := header(data, at):
            return h
        at += 1
    raise AudioError("mp3: no frame")


#: Samples that a decoder's output lags behind, and the longest delay or padding that a tag is believed.
LAG, BELIEVED = 529, 5000


def gapless(data: bytes, at: int, size: int) -> tuple[int, int] | None:
    """Samples that the encoder says it has put in front and behind, by a tag in the first frame (0 and 0 if it says nothing); None without a tag."""
    found = [i for i in (data.find(b"Xing", at, at + size), data.find(b"Info", at, at + size)) if i >= 0]
    if not found:
        return None
    tag = min(found)
    if tag + 8 > len(data):
        raise AudioError("mp3: the tag of the first frame is cut short")
    flags = int.from_bytes(data[tag + 4 : tag + 8], "big")
    place = tag + 8 + sum(n for bit, n in ((1, 4), (2, 4), (4, 100), (8, 4)) if flags & bit) + 21
    if place + 3 > len(data):
        return 0, 0
    both = int.from_bytes(data[place : place + 3], "big")
    front, behind = both >> 12, both & 0xFFF
    return (0, 0) if max(front, behind) > BELIEVED else (front, behind)


def _refused(data: bytes) -> AudioError:
    """Why there is no frame of layer 3."""
    at, end = span(data)
    while 0 <= (at := data.find(b"\xff", at, end - 1)):
        layer = 4 - (data[at + 1] >> 1 & 3)
        if data[at + 1] & 0xE0 == 0xE0 and layer in (1, 2):
            return AudioError(f"mp3: layer {layer} is another codec, which is not decoded")
        at += 1
    return AudioError("mp3: no frame header")


def read_mp3(data: bytes, tables: layer3.Tables | None = None) -> tuple[int, int, np.ndarray]:
    """rate, channels and interleaved samples. tables: what layer3.load_tables() gives; silence needs none."""
    tables, walked = tables or layer3.Tables(), frames(data)
    if not walked:
        raise _refused(data)
    (begin, head), channels = walked[0], walked[0][1]["channels"]
    trim, first = gapless(data, begin, head["size"]), head["version"] == 3
    side = (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    streams = [layer3.Stream(channels)]
    for number, (at, h) in enumerate(walked):
        extension, checked = coding(data, at)
        start, now = at + 4 + 2 * checked, streams[-1]
        payload = data[start + side : at + h["size"]]
        known = layer3.read_side(layer3.Bits(data[start : start + side]), first, channels)
        if known is None or start + side > at + h["size"] or sum(s["length"] for row in known[1] for s in row) > 8 * (len(payload) + known[0]):
            streams.append(layer3.Stream(channels))
            continue
        back, granules = known
        main = (now.reservoir[-back:] if back else b"") + payload
        used = 0
        if len(now.reservoir) >= back and not (trim and not number):
            try:
                used = now.add(main, granules, h["rate"], first, extension, tables)
            except layer3.LostFrame:
                streams.append(layer3.Stream(channels))
                continue
        now.reservoir = main[(used + 7) // 8 :][-layer3.RESERVOIR :]
    samples = np.concatenate([s.samples(tables.window) for s in streams])
    if trim:
        samples = samples[min(trim[0] + LAG, len(samples)) : max(0, len(samples) - max(0, trim[1] - LAG))]
    return head["rate"], channels, samples.reshape(-1).astype(np.float32)


def silent_frames(n: int, rate: int = 44100, channels: int = 1) -> bytes:
    """n frames at 128 kbit/s (64 in the second version) whose granules have no spectrum."""
    version = next((v for v, rates in RATES.items() if rate in rates), None)
    if version is None or channels not in (1, 2):
        raise AudioError(f"mp3: no such stream: {rate} Hz, {channels} channels")
    head = bytes([0xFF, 0xE0 | version << 3 | 3, (9 if version == 3 else 8) << 4 | RATES[version].index(rate) << 2, 0xC0 if channels == 1 else 0])
    return head.ljust(header(head, 0)["size"], b"\0") * n
