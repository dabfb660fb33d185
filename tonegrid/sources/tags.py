"""Tags: ID3v1, ID3v2.2 to 2.4, Vorbis comments (in Ogg and FLAC) and MP4 atoms, into one shape."""

from __future__ import annotations

import json

from ..model import NUMBER_TAGS, TEXT_TAGS
from . import flac, mp4, ogg

#: Limits.
MAX_TAG = 64 << 20
ID3V1 = 128
#: The names that the schemes use for each field.
NAMES = {
    "title": ("TITLE", "TIT2", "TT2"),
    "artist": ("ARTIST", "TPE1", "TP1"),
    "album": ("ALBUM", "TALB", "TAL"),
    "albumArtist": ("ALBUMARTIST", "ALBUM ARTIST", "TPE2", "TP2"),
    "composer": ("COMPOSER", "TCOM", "TCM"),
    "genre": ("GENRE", "TCON", "TCO"),
    "comment": ("COMMENT", "DESCRIPTION", "COMM", "COM"),
    "date": ("DATE", "TDRC", "TYER", "TYE", "YEAR"),
    "trackNumber": ("TRACKNUMBER", "TRACK", "TRCK", "TRK"),
    "trackTotal": ("TRACKTOTAL", "TOTALTRACKS"),
    "discNumber": ("DISCNUMBER", "DISC", "TPOS", "TPA"),
    "discTotal": ("DISCTOTAL", "TOTALDISCS"),
}
#: MP4 atoms with names of their own.
ATOMS = {b"\xa9nam": "TITLE", b"\xa9ART": "ARTIST", b"\xa9alb": "ALBUM", b"aART": "ALBUMARTIST", b"\xa9wrt": "COMPOSER", b"\xa9gen": "GENRE", b"\xa9day": "DATE", b"\xa9cmt": "COMMENT", b"\xa9too": "ENCODER"}
_FIELD = {name: field for field, names in NAMES.items() for name in names}
_UPPER = {i: i - 32 for i in range(ord("a"), ord("z") + 1)}


def empty() -> dict:
    return {n: "" for n in TEXT_TAGS} | {n: 0 for n in NUMBER_TAGS} | {"other": []}


def split_count(text: str) -> tuple[int, int]:
    """number and total of "3/12"; a character after the number ends it, a second slash ends the total."""
    number = total = ""
    for i, part in enumerate(text.split("/")[:2]):
        for c in part:
            if c in "0123456789":
                number, total = (number + c, total) if i == 0 else (number, total + c)
            elif i == 0 and number:
                return int(number), 0
    return int(number or 0), int(total or 0)


def assign(tags: dict, key: str, value: str) -> None:
    """Route a name and value to its field; empty values say nothing, unknown names go to other, the last value wins."""
    if not value:
        return
    field = _FIELD.get(key)
    if field is None:
        tags["other"].append((key, value))
    elif field in TEXT_TAGS:
        tags[field] = value
    else:
        number, total = split_count(value)
        tags[field] = number
        if field.endswith("Number") and total:
            tags[field.replace("Number", "Total")] = total


def _trim(text: str) -> str:
    return text.strip("\0 ")


def _utf16(body: bytes, big: bool) -> str:
    return body[: len(body) // 2 * 2].decode("utf-16-be" if big else "utf-16-le", "replace")


def id3_text(encoding: int, body: bytes) -> str:
    """Text of an ID3 frame by its encoding byte; anything unknown reads as Latin-1, invalid sequences as replacement characters."""
    if encoding == 1:
        if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return _utf16(body[2:], body[:2] == b"\xfe\xff")
        return _utf16(body, False)
    if encoding == 2:
        return _utf16(body, True)
    return body.decode("utf-8", "replace") if encoding == 3 else body.decode("latin-1")


def syncsafe(raw: bytes) -> int:
    value = 0
    for b in raw:
        value = value << 7 | b & 0x7F
    return value


def id3v2(data: bytes) -> dict:
    tags = empty()
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (2, 3, 4):
        return tags
    version, size = data[3], syncsafe(data[6:10])
    if not 0 < size <= MAX_TAG:
        return tags
    end, at = min(len(data), 10 + size), 10
    if data[5] & 0x40 and at + 4 <= end:
        more = syncsafe(data[at : at + 4]) if version == 4 else int.from_bytes(data[at : at + 4], "big") + 4
        if more and at + more <= end:
            at += more
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= end and data[at]:
        name = data[at : at + name_size].decode("latin-1")
        raw = data[at + name_size : at + 2 * name_size]
        length = syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if not length or at + head + length > end:
            break
        _id3_frame(tags, name, data[at + head : at + head + length])
        at += head + length
    return tags


def _id3_frame(tags: dict, name: str, body: bytes) -> None:
    if len(body) < 2:
        return
    if name in ("TXXX", "TXX"):
        key, zero, value = id3_text(body[0], body[1:]).partition("\0")
        if key and zero:
            assign(tags, _trim(key).translate(_UPPER), _trim(value))
    elif name in ("COMM", "COM"):
        if len(body) >= 5:
            first, zero, rest = id3_text(body[0], body[4:]).partition("\0")
            assign(tags, "COMM", _trim(rest if zero else first))
    elif name[0] == "T":
        assign(tags, name, _trim(id3_text(body[0], body[1:]).partition("\0")[0]))


def id3v1(data: bytes) -> dict:
    tags, tail = empty(), data[-ID3V1:]
    if len(tail) < ID3V1 or tail[:3] != b"TAG":
        return tags
    text = lambda a, b: _trim(tail[a:b].decode("latin-1"))
    for key, a, b in (("TITLE", 3, 33), ("ARTIST", 33, 63), ("ALBUM", 63, 93), ("DATE", 93, 97)):
        assign(tags, key, text(a, b))
    numbered = tail[125] == 0 and tail[126] != 0
    if numbered:
        tags["trackNumber"] = tail[126]
    assign(tags, "COMMENT", text(97, 125 if numbered else 127))
    if tail[127] != 255:
        tags["other"].append(("GENRECODE", str(tail[127])))
    return tags


def vorbis_comment(body: bytes) -> dict:
    tags = empty()
    u32 = lambda at: int.from_bytes(body[at : at + 4], "little")
    if len(body) < 8 or 8 + u32(0) > len(body):
        return tags
    at = 4 + u32(0)
    count, at = u32(at), at + 4
    if count > len(body) // 4:
        return tags
    for _ in range(count):
        if at + 4 > len(body) or at + 4 + u32(at) > len(body):
            break
        entry = body[at + 4 : at + 4 + u32(at)]
        at += 4 + len(entry)
        key, equals, value = entry.partition(b"=")
        if key and equals:
            assign(tags, key.decode("utf-8", "replace").translate(_UPPER), value.decode("utf-8", "replace"))
    return tags


def mp4_tags(data: bytes) -> dict:
    """Atoms of the item list. Atoms without a name of their own keep theirs; pictures and other non-text stay out."""
    tags = empty()
    meta = mp4.find(data, 0, len(data), [b"moov", b"udta", b"meta"])
    items = meta and mp4.find(data, meta[0] + 4, meta[1], [b"ilst"])
    if not items:
        return tags
    for name, body, end in mp4.boxes(data, *items):
        for kind, at, stop in mp4.boxes(data, body, end):
            if kind != b"data" or at + 8 > stop:
                continue
            value = data[at + 8 : stop]
            if name in (b"trkn", b"disk"):
                if len(value) >= 6:
                    field = "track" if name == b"trkn" else "disc"
                    tags[field + "Number"], tags[field + "Total"] = int.from_bytes(value[2:4], "big"), int.from_bytes(value[4:6], "big")
                continue
            try:
                text = value.decode("utf-8")
            except UnicodeDecodeError:
                continue
            assign(tags, ATOMS.get(name, name.decode("latin-1")), _trim(text))
    return tags


def merge(newer: dict, older: dict) -> dict:
    """newer, with what it leaves empty of title, artist, album, date, comment and track number from older, and older's unseen others."""
    out = dict(newer)
    for field in ("title", "artist", "album", "date", "comment", "trackNumber"):
        out[field] = newer[field] or older[field]
    known = {k for k, _ in newer["other"]}
    out["other"] = newer["other"] + [(k, v) for k, v in older["other"] if k not in known]
    return out


def read_tags(data: bytes) -> dict:
    """Whatever scheme the bytes carry; empty tags if none."""
    if len(data) < 8:
        return empty()
    if data[:3] == b"ID3" or (data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        return merge(id3v2(data), id3v1(data))
    if data[:4] == b"fLaC":
        return _flac_tags(data)
    if data[:4] == b"OggS":
        found = ogg.packets(data)
        body = found[1]["data"] if len(found) > 1 else b""
        return vorbis_comment(body[7:]) if len(body) >= 8 and body[:7] == b"\3vorbis" else empty()
    if data[4:8] == b"ftyp":
        return mp4_tags(data)
    return empty()


def _flac_tags(data: bytes) -> dict:
    at = 4
    while at + 4 <= len(data):
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            break
        if kind == 4:
            return vorbis_comment(data[at + 4 : at + 4 + size])
        if data[at] >> 7:
            break
        at += 4 + size
    return empty()


def is_empty(tags: dict) -> bool:
    return not any(tags[n] for n in (*TEXT_TAGS, "trackNumber", "discNumber")) and not tags["other"]


def to_json(tags: dict) -> str:
    return json.dumps({n: tags[n] for n in (*TEXT_TAGS, *NUMBER_TAGS)} | {"other": [{"key": k, "value": v} for k, v in tags["other"]]}, ensure_ascii=False, separators=(",", ":"))


# --- writing, for tests and queries ------------------------------------------


def write_id3v1(title: str, artist: str, album: str, year: str, comment: str, track: int = 0, genre: int = 255) -> bytes:
    field = lambda t, n: t.encode("latin-1", "replace")[:n].ljust(n, b"\0")
    note = field(comment, 28) + b"\0" + bytes([track]) if track else field(comment, 30)
    return b"TAG" + field(title, 30) + field(artist, 30) + field(album, 30) + field(year, 4) + note + bytes([genre])


def write_id3v2(frames: list[tuple[str, str]], version: int = 3, encoding: int = 1) -> bytes:
    """Text frames (and TXXX as "name\\0value", COMM as text) in version 2, 3 or 4."""
    out = b""
    for name, text in frames:
        body = bytes([encoding]) + (b"eng\0" if name in ("COMM", "COM") and encoding in (0, 3) else b"eng" if name in ("COMM", "COM") else b"")
        if name in ("COMM", "COM") and encoding in (1, 2):
            text = "\0" + text
        coded = {0: lambda: text.encode("latin-1", "replace"), 1: lambda: b"\xff\xfe" + text.encode("utf-16-le"), 2: lambda: text.encode("utf-16-be"), 3: lambda: text.encode()}[encoding]()
        body += coded
        n = len(body)
        size = n.to_bytes(3, "big") if version == 2 else n.to_bytes(4, "big") if version == 3 else bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
        out += name.encode() + size + (b"" if version == 2 else b"\0\0") + body
    return b"ID3" + bytes([version, 0, 0]) + bytes(len(out) >> s & 0x7F for s in (21, 14, 7, 0)) + out


def write_vorbis_comment(entries: list[tuple[str, str]], vendor: str = "tonegrid") -> bytes:
    u32 = lambda n: n.to_bytes(4, "little")
    fields = [f"{k}={v}".encode() for k, v in entries]
    return u32(len(vendor.encode())) + vendor.encode() + u32(len(fields)) + b"".join(u32(len(f)) + f for f in fields)


def write_flac_tags(entries: list[tuple[str, str]]) -> bytes:
    """A FLAC head with the comment block, without frames."""
    info = flac.write_flac([], 8000, 1)[8:42]
    body = write_vorbis_comment(entries)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(body).to_bytes(3, "big") + body


def write_mp4_tags(entries: list[tuple[bytes, bytes]]) -> bytes:
    """ftyp and moov with an item list."""
    items = [mp4.box(k, mp4.box(b"data", (0 if k in (b"trkn", b"disk") else 1).to_bytes(4, "big"), bytes(4), v)) for k, v in entries]
    return mp4.box(b"ftyp", b"M4A ", bytes(4)) + mp4.box(b"moov", mp4.box(b"udta", mp4.full(b"meta", mp4.box(b"ilst", *items))))


