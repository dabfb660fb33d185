"""MP4: boxes, the first audio track and its coded frames; and a small writer for one track."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..model import AudioError

#: Limits.
MAX_DEPTH, MAX_SAMPLES = 16, 1 << 22
SETUP_BOXES = (b"alac", b"esds", b"dfLa", b"dOps")


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of boxes that follow each other; stops at nonsense; ends never pass the data."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        stop = end if size == 0 else at + size
        if stop < at + head:
            return
        yield kind, at + head, min(stop, end)
        at = stop


def find(data: bytes, at: int, end: int, path: list[bytes], depth: int = 0) -> tuple[int, int] | None:
    """Body of the first box at a path."""
    if depth > MAX_DEPTH:
        return None
    for kind, body, stop in boxes(data, at, end):
        if kind == path[0]:
            found = (body, stop) if len(path) == 1 else find(data, body, stop, path[1:], depth + 1)
            if found:
                return found
    return None


def _u32s(data: bytes, at: int, n: int, end: int) -> list[int]:
    if n > MAX_SAMPLES or at + 4 * n > end:
        raise AudioError("mp4: a sample table is truncated or too long")
    return list(struct.unpack_from(f">{n}I", data, at))


def track_tables(data: bytes) -> dict:
    """codec, rate, channels, bits, setup, timescale, duration, and the raw sample tables of the first sound track."""
    moov = find(data, 0, len(data), [b"moov"])
    if not moov:
        raise AudioError("mp4: no moov box")
    for kind, body, end in boxes(data, *moov):
        if kind != b"trak":
            continue
        handler = find(data, body, end, [b"mdia", b"hdlr"])
        if not handler or data[handler[0] + 8 : handler[0] + 12] != b"soun":
            continue
        table = find(data, body, end, [b"mdia", b"minf", b"stbl"])
        entry = table and find(data, *table, [b"stsd"])
        if not entry:
            continue
        return _entry(data, *entry) | _media_head(data, find(data, body, end, [b"mdia", b"mdhd"])) | _tables(data, *table)
    raise AudioError("mp4: no audio track")


def _entry(data: bytes, at: int, end: int) -> dict:
    for kind, body, stop in boxes(data, at + 8, end):
        if body + 28 > stop:
            raise AudioError("mp4: sample entry is too short")
        channels, bits = struct.unpack_from(">HH", data, body + 16)
        setup = next((data[b:e] for k, b, e in boxes(data, body + 28, stop) if k in SETUP_BOXES), b"")
        return {"codec": kind.decode("latin-1"), "channels": channels, "bits": bits, "entry_rate": int.from_bytes(data[body + 24 : body + 28], "big") >> 16, "setup": setup}
    raise AudioError("mp4: no sample entry")


def _media_head(data: bytes, found) -> dict:
    if not found:
        return {"timescale": 0, "duration": 0}
    at, end = found
    wide = data[at : at + 1] == b"\1"
    if at + (32 if wide else 20) > end:
        return {"timescale": 0, "duration": 0}
    scale, length = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    return {"timescale": scale, "duration": length}


def _tables(data: bytes, at: int, end: int) -> dict:
    one = lambda kind: find(data, at, end, [kind])
    stsz, stsc, stco, co64 = one(b"stsz"), one(b"stsc"), one(b"stco"), one(b"co64")
    if not stsz or not stsc or not (stco or co64):
        raise AudioError("mp4: a sample table is missing")
    same, n = _u32s(data, stsz[0] + 4, 2, stsz[1])
    if n > MAX_SAMPLES:
        raise AudioError("mp4: too many samples")
    sizes = [same] * n if same else _u32s(data, stsz[0] + 12, n, stsz[1])
    (count,) = _u32s(data, (stco or co64)[0] + 4, 1, (stco or co64)[1])
    if stco:
        chunks = _u32s(data, stco[0] + 8, count, stco[1])
    else:
        flat = _u32s(data, co64[0] + 8, 2 * count, co64[1])
        chunks = [a << 32 | b for a, b in zip(flat[::2], flat[1::2])]
    (count,) = _u32s(data, stsc[0] + 4, 1, stsc[1])
    flat = _u32s(data, stsc[0] + 8, 3 * count, stsc[1])
    return {"sizes": sizes, "chunks": chunks, "runs": list(zip(flat[::3], flat[1::3]))}


def sample_offsets(tables: dict) -> list[tuple[int, int]]:
    """(offset, size) of each coded frame: each chunk has as many as the last run that begins at or before it says."""
    out, run, runs, sizes = [], 0, tables["runs"], tables["sizes"]
    for number, offset in enumerate(tables["chunks"], 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        per = runs[run][1] if runs and runs[run][0] <= number else 0
        for size in sizes[len(out) : len(out) + per]:
            out.append((offset, size))
            offset += size
        if len(out) >= len(sizes):
            break
    return out


def audio_track(data: bytes) -> dict:
    """track_tables() with rate (the media's time scale, else the entry's) and samples."""
    t = track_tables(data)
    return t | {"rate": t["timescale"] or t["entry_rate"], "samples": sample_offsets(t)}


def sample_data(data: bytes, sample: tuple[int, int]) -> bytes:
    offset, size = sample
    if offset + size > len(data):
        raise AudioError("mp4: a coded frame lies past the end")
    return data[offset : offset + size]


# --- writing ----------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def write_track(codec: bytes, setup: bytes, rate: int, channels: int, bits: int, frames: list[bytes], frame_length: int, total: int, per_chunk: int = 8, udta: bytes = b"") -> bytes:
    """An M4A file of one sound track; chunks of `per_chunk` coded frames."""
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"M4A ", u32(0), b"M4A ", b"mp42", b"isom")
    entry = box(codec, bytes(6), b"\0\1", bytes(8), struct.pack(">HHHH", channels, bits, 0, 0), (min(rate, 65535) << 16).to_bytes(4, "big"), setup)
    last = total - frame_length * (len(frames) - 1)
    stts = u32(2, len(frames) - 1, frame_length, 1, last) if len(frames) > 1 else u32(1, 1, last)
    n_chunks, rest = divmod(len(frames), per_chunk)
    runs = ([(1, per_chunk)] if n_chunks else []) + ([(n_chunks + 1, rest)] if rest else [])

    def moov(at: int) -> bytes:
        starts, here = [], at
        for i, f in enumerate(frames):
            if i % per_chunk == 0:
                starts.append(here)
            here += len(f)
        table = box(b"stbl", full(b"stsd", u32(1), entry), full(b"stts", stts), full(b"stsc", u32(len(runs)), *(u32(a, b, 1) for a, b in runs)), full(b"stsz", u32(0, len(frames)), *(u32(len(f)) for f in frames)), full(b"stco", u32(len(starts), *starts)))
        media = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", u32(1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", u32(0, 0, rate, total), b"\x55\xc4\0\0"), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), media)
        trak = box(b"trak", full(b"tkhd", u32(0, 0, 1, 0, total), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, u32(0, 0), flags=7), mdia)
        return box(b"moov", full(b"mvhd", u32(0, 0, rate, total, 0x10000), b"\1\0", bytes(10), matrix, bytes(24), u32(2)), trak, udta)

    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + 8) + box(b"mdat", *frames)
