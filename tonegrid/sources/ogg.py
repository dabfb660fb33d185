"""Ogg: pages into packets, by logical stream; and a writer of pages, for tests and queries."""

from __future__ import annotations

import struct

from ..model import AudioError
from .bits import crc

#: Page head, flags and limit.
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_PACKET = 16 << 20


def pages(data: bytes):
    """(flags, granule, serial, lacing values, body) of each page, its check verified."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise AudioError("ogg: truncated page header")
        magic, version, flags, granule, serial, _, check, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise AudioError("ogg: lost page sync")
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        stop = at + HEAD.size + n + sum(lacing)
        if len(lacing) < n or stop > len(data):
            raise AudioError("ogg: truncated page")
        if crc(data[at : at + 22] + bytes(4) + data[at + 26 : stop], 32) != check:
            raise AudioError("ogg: page check differs")
        yield flags, granule, serial, lacing, data[at + HEAD.size + n : stop]
        at = stop


def streams(data: bytes) -> dict[int, list[dict]]:
    """Packets of each logical stream, in order: data, granule (-1 unless the page ends with the packet), whether it ends the stream.

    A packet ends at a lacing value below 255. One that should go on in a page that doesn't continue it is dropped, and so is an unfinished last one."""
    out: dict[int, list[dict]] = {}
    open_: dict[int, bytes | None] = {}
    for flags, granule, serial, lacing, body in pages(data):
        packets, held = out.setdefault(serial, []), open_.get(serial)
        if not flags & CONTINUED:
            held = None
        skip = bool(flags & CONTINUED) and held is None  # the rest of a packet whose start isn't here
        part, at = held or b"", 0
        for i, size in enumerate(lacing):
            part += body[at : at + size]
            at += size
            if len(part) > MAX_PACKET:
                raise AudioError("ogg: packet exceeds the safety limit")
            if size < 255:
                if not skip:
                    ends = i == len(lacing) - 1
                    packets.append({"data": part, "granule": granule if ends else -1, "ends": ends and bool(flags & LAST)})
                skip, part = False, b""
        open_[serial] = part if lacing and lacing[-1] == 255 and not skip else None
    return out


def packets(data: bytes) -> list[dict]:
    """Packets of the first logical stream."""
    return next(iter(streams(data).values()), [])


def write_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda check: HEAD.pack(b"OggS", 0, flags, granule, serial, number, check, len(lacing))
    return head(crc(head(0) + lacing + body, 32)) + lacing + body


def write_stream(contents: list[bytes], serial: int = 1, per_page: int = 255) -> bytes:
    """Pages of packets; a page holds at most `per_page` lacing values, so that long packets go on over pages."""
    segments = []  # (size, packet number, whether it ends the packet)
    for n, c in enumerate(contents):
        segments += [(255, n, False)] * (len(c) // 255) + [(len(c) % 255, n, True)]
    out, whole, at, open_ = [], b"".join(contents), 0, False
    groups = [segments[i : i + per_page] for i in range(0, len(segments), per_page)]
    for number, group in enumerate(groups):
        flags = (CONTINUED if open_ else 0) | (FIRST if number == 0 else 0) | (LAST if number == len(groups) - 1 else 0)
        size = sum(s for s, _, _ in group)
        ended = [n for _, n, e in group if e]
        out.append(write_page(flags, (ended[-1] + 1) * 100 if ended else -1, serial, number, bytes(s for s, _, _ in group), whole[at : at + size]))
        at += size
        open_ = not group[-1][2]
    return b"".join(out)
