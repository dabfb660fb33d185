"""What a file holds, from its first bytes, and decoding by container."""

from __future__ import annotations

import numpy as np

from ..model import AudioError
from . import alac, flac, mp3, mp4, ogg, pcm_files, vorbis

#: Bytes that a probe reads first, and how far into an Ogg file the codec's mark may stand.
PREFIX, OGG_MARK = 128 << 10, 4096


def sniff(data: bytes) -> str:
    """The container by its first bytes."""
    if len(data) < 4:
        return "unknown"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if data[:4] == b"fLaC":
        return "flac"
    if data[:4] == b"OggS":
        return "ogg"
    if data[4:8] == b"ftyp":
        return "mp4"
    if data[:3] == b"ID3" or (data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        return "mp3"
    return "unknown"


def decode(data: bytes, mp3_tables=None) -> tuple[int, int, np.ndarray]:
    """rate, channels and interleaved samples of whatever this is. mp3_tables: what layer3.load_tables() gives."""
    kind = sniff(data)
    if kind == "unknown":
        raise AudioError("unrecognised audio container")
    return {"wav": pcm_files.read_wave, "aiff": pcm_files.read_aiff, "flac": flac.read_flac, "mp4": alac.read_alac, "ogg": vorbis.read_vorbis, "mp3": lambda raw: mp3.read_mp3(raw, mp3_tables)}[kind](data)


def _found(container: str, codec: str, rate: int, channels: int, frames: int | None) -> dict:
    return {"container": container, "codec": codec, "sample_rate": rate, "channels": channels, "frames": frames or 0, "frames_known": frames is not None}


def probe_wave(data: bytes) -> dict:
    """Frames come from the data chunk's declared size, so a prefix is enough."""
    form = size = None
    for name, at, n in pcm_files.chunks(data, False, "wav", False):
        if name == b"fmt ":
            form = pcm_files.wave_format(data, at, n)
        elif name == b"data" and size is None:
            size = n
    if form is None:
        raise AudioError("wav: no fmt chunk")
    encoding, channels, rate, bits = form
    block = channels * (bits // 8)
    codec = {pcm_files.PCM: "pcm", pcm_files.FLOAT: "float"}.get(encoding, f"0x{encoding:04x}")
    return _found("wav", codec, rate, channels, size // block if size is not None and block else None)


def probe_aiff(data: bytes) -> dict:
    for name, at, n in pcm_files.chunks(data, True, "aiff", False):
        if name == b"COMM":
            channels, frames, _, rate, kind = pcm_files.aiff_common(data, at, n)
            return _found("aiff", "float" if kind in pcm_files.AIFC_FLOAT else "pcm", rate, channels, frames)
    raise AudioError("aiff: no COMM chunk")


def probe_flac(data: bytes) -> dict:
    if len(data) < 42:
        raise AudioError("flac: STREAMINFO is too short")
    info = flac._parse_info(data[8:42])
    return _found("flac", "flac", info["rate"], info["channels"], info["total"] or None)


def probe_mp4(data: bytes) -> dict:
    t = mp4.track_tables(data)
    rate = t["timescale"] or t["entry_rate"]
    codec = t["codec"].strip()
    if codec == "alac":
        c = alac.parse_cookie(t["setup"])
        return _found("mp4", codec, c["rate"] or rate, c["channels"], t["duration"] * (c["rate"] or rate) // t["timescale"] if t["timescale"] else None)
    return _found("mp4", codec, rate, t["channels"], t["duration"] if t["timescale"] else None)


def probe_ogg(data: bytes) -> dict:
    at = data[:OGG_MARK].find(b"\x01vorbis")
    if at < 0 or at + 16 > len(data):
        return _found("ogg", vorbis.codec_name(data), 0, 0, None)
    return _found("ogg", "vorbis", int.from_bytes(data[at + 12 : at + 16], "little"), data[at + 11], None)


def probe_mpeg(data: bytes) -> dict:
    head = mp3.first_header(data)
    return _found("mp3", "mp3", head["rate"], head["channels"], None)


PROBES = {"wav": probe_wave, "aiff": probe_aiff, "flac": probe_flac, "mp4": probe_mp4, "ogg": probe_ogg, "mp3": probe_mpeg}


def probe(data: bytes, whole=None) -> dict:
    """The probe of a prefix; where that isn't enough and `whole` can give all bytes, of those."""
    kind = sniff(data)
    if kind not in PROBES:
        raise AudioError("unrecognised audio container")
    try:
        return PROBES[kind](data)
    except AudioError:
        if whole is None:
            raise
        return PROBES[kind](whole())


def exact(data: bytes, mp3_tables=None) -> dict:
    """The probe of a full decode: frames are counted."""
    rate, channels, samples = decode(data, mp3_tables)
    found = probe(data)
    return found | {"sample_rate": rate, "channels": channels, "frames": len(samples) // channels, "frames_known": True}


