"""Media columns: payloads in archives of 8-bit images, written and read by a custom data source.

A payload (UTF-8 bytes with zeros up to a positive multiple of 64) is stored losslessly as a greyscale PNG, 64 samples wide.
Archives hold members one after the other: a head (magic, flags, doc_id, sizes, crc32 of the stored form) and the stored
form; an index beside each lists the members' offsets. Format "media_archive":

- writing: each task streams its rows into an archive of its own; only archives named in the manifests that the commit
  writes count, so what a failed or repeated task leaves behind is never read.
- reading: planned as byte ranges over the archives' sizes, as the manifests give them; a task takes the members whose head
  starts in its range, streams them out as Arrow batches, and retries each member by its offset without touching others.

Null text: empty, so 64 zeros. Null doc_id: kept. Repeated rows: a member each. Empty table: no archives, no rows.
Very long texts: one member, read whole by one task. Other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import arrow, new_path, texts

WIDTH = 64
#: Fixed values of the PNG format: its signature, and the head of an 8-bit greyscale image.
PNG = b"\x89PNG\r\n\x1a\n"
HEAD = struct.Struct("<4sBqqqI")  # magic, 1 if doc_id is null, doc_id, payload bytes before padding, stored bytes, crc32
MAGIC = b"TGM1"
SCHEMA = "doc_id long, n_bytes long, media binary, archive string, offset long"


def pad(raw: bytes) -> bytes:
    """raw with zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG, 64 samples a row, rows unfiltered. payload: a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an image that encode_png() made, row by row; ValueError if anything is amiss."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, shape, body = 8, None, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"crc of {kind!r} differs")
        if kind == b"IHDR":
            shape = struct.unpack_from(">IIBB", media, at + 8)
        elif kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    if not shape or shape[2:] != (8, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return np.ascontiguousarray(lines[:, 1:]).reshape(-1)


def feature(samples: np.ndarray) -> str:
    """Integer statistics of the samples, so equal everywhere: size, sum, energy about 128, sign changes, 16-bin histogram."""
    signed = samples.astype(np.int64) - 128
    turns = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    bins = np.bincount(samples >> 4, minlength=16)
    return f"{WIDTH}x{len(samples) // WIDTH};sum={int(samples.sum(dtype=np.int64))};energy={int((signed * signed).sum())};turns={turns};bins=" + ",".join(map(str, bins))


def files(path: str):
    """The file system of a path with or without a scheme, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    archive: str
    size: int
    members: int


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = files(self.path)
        system.create_dir(root, recursive=True)
        name, size, offsets = uuid.uuid4().hex, 0, []
        with system.open_output_stream(f"{root}/{name}.arc") as out:
            for batch in iterator:
                for doc_id, n, media in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    offsets.append(size)
                    out.write(HEAD.pack(MAGIC, doc_id is None, doc_id or 0, n, len(media), zlib.crc32(media)))
                    out.write(media)
                    size += HEAD.size + len(media)
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return Written(name, size, len(offsets))

    def commit(self, messages) -> None:
        system, root = files(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.archive, m.size, m.members] for m in messages if m and m.members]).encode())

    def abort(self, messages) -> None:
        system, root = files(self.path)
        for m in filter(None, messages):
            for end in ("arc", "idx"):
                system.delete_file(f"{root}/{m.archive}.{end}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, tries: int, batch_bytes: int):
        self.path, self.range_bytes, self.tries, self.batch_bytes = path, range_bytes, tries, batch_bytes

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = files(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size, _ in sorted(found) for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def _member(self, system, root: str, archive: str, offset: int) -> tuple:
        """One member, tried again from its offset with a new handle."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with system.open_input_file(f"{root}/{archive}.arc") as f:
                    return self._read(f, offset)
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.05 * 2 ** (self.tries - left))

    @staticmethod
    def _read(f, offset: int) -> tuple:
        f.seek(offset)
        head = f.read(HEAD.size)
        if len(head) < HEAD.size:
            raise ValueError(f"no whole member at {offset}")
        magic, null, doc_id, n, stored, crc = HEAD.unpack(head)
        media = f.read(stored)
        if magic != MAGIC or zlib.crc32(media) != crc:
            raise ValueError(f"no whole member at {offset}")
        return (None if null else doc_id, n, media)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, root = files(self.path)
        with system.open_input_stream(f"{root}/{partition.archive}.idx") as f:
            offsets = np.frombuffer(f.read(), "<i8")
        offsets = offsets[np.searchsorted(offsets, partition.start) : np.searchsorted(offsets, partition.end)]
        rows, held = [], 0
        with system.open_input_file(f"{root}/{partition.archive}.arc") as f:
            for offset in offsets.tolist():
                try:
                    member = self._read(f, offset)
                except (OSError, ValueError):
                    member = self._member(system, root, partition.archive, offset)
                rows.append((*member, partition.archive, offset))
                held += len(member[2])
                if held >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "media", "archive", "offset"])


class MediaArchive(DataSource):
    """Options: path; range_bytes, tries, batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("tries", 4)), int(self.options.get("batch_bytes", 4 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode append")
        return ArchiveWriter(self.options["path"])


def write_archives(docs: DataFrame, path: str) -> None:
    """Store the texts of docs as images in archives below path."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    arrow(spark)

    def stored(batches):
        for batch in batches:
            raw = [t.encode() for t in batch["text"].to_pylist()]
            names = ["doc_id", "n_bytes", "media", "archive", "offset"]
            nulls = pa.nulls(len(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_png(pad(r)) for r in raw], pa.binary()), nulls.cast(pa.string()), nulls.cast(pa.int64())], names=names)

    texts(docs).mapInArrow(stored, SCHEMA).write.format("media_archive").mode("append").save(path)


def read_archives(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def media_features(members: DataFrame) -> DataFrame:
    """What each stored member holds: sizes, digests of the payload and of the stored form, and a feature of the samples."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                samples = decode_png(media)
                payload = samples.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the texts to archives below path (a new folder of the shared folder), read them back and describe them."""
    path = path or new_path(docs.sparkSession, "media")
    write_archives(docs, path)
    return media_features(read_archives(docs.sparkSession, path, **options))
