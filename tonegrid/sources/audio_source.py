"""The data source "audio": files of a folder as rows, and rows as files.

Options: path (a folder); mode: probe (reads first bytes only), tags or decode; sample_rate, mono and mp3_tables (a file on the driver) for decode; bytes_per_task.
Folders that only Spark can read go through binaryFile and tonegrid.operators.audio instead; see read_binary()."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import BUFFER, ERROR, PROBE, TAGS, ArgumentError
from . import layer3
from . import probe as probing
from . import tags as tagging

SCHEMAS = {"probe": PROBE, "tags": TAGS, "decode": BUFFER}


#: Bytes that a batch of rows should hold.
BATCH_BYTES = 8 << 20


def _schema(mode: str) -> str:
    if mode not in SCHEMAS:
        raise ArgumentError(f"mode must be probe, tags or decode, not {mode}")
    return f"path string, {SCHEMAS[mode]}, error {ERROR}"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    paths: list


class AudioReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.mode, self.options = options["path"], options.get("mode", "decode"), dict(options)
        self.schema = to_arrow_schema(schema)
        self.tables = layer3.load_tables(options["mp3_tables"]) if options.get("mp3_tables") else None

    def partitions(self) -> list[InputPartition]:
        """Files dealt by size, so that a task reads about bytes_per_task. The listing is the driver's, as for any file source of Spark: a
        path and a size for each file."""
        from pyarrow import fs

        system, root = _files(self.path)
        most, groups, held = int(self.options.get("bytes_per_task", 64 << 20)), [[]], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            cost = min(info.size, probing.PREFIX) if self.mode == "probe" else info.size
            if groups[-1] and held + cost > most:
                groups.append([])
                held = 0
            groups[-1].append((info.path, info.size))
            held += cost
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Arrow batches of about BATCH_BYTES; samples go over as one array, never value by value."""
        from ..operators.audio import _guarded

        system, _ = _files(self.path)
        rows, held = [], 0
        for path, size in partition.paths:
            with system.open_input_file(path) as f:
                data = f.read(min(size, probing.PREFIX) if self.mode == "probe" else size)
                whole = lambda f=f: (f.seek(0), f.read())[1]
                found, error = _guarded(lambda raw, whole=whole: self._row(raw, whole), data, "permissive")
            rows.append((path, *(found or [None] * (len(self.schema) - 2)), error))
            held += 4 * len(found[3]) if found and self.mode == "decode" else 1000
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        columns = []
        for field, values in zip(self.schema, zip(*rows)):
            if field.name == "samples":
                some = [np.zeros(0, np.float32) if v is None else np.asarray(v, np.float32) for v in values]
                ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some), pa.float32()), mask=pa.array([v is None for v in values])))
            else:
                columns.append(pa.array(values, field.type))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)

    def _row(self, data: bytes, whole) -> list:
        if self.mode == "probe":
            return list(probing.probe(data, whole).values())
        if self.mode == "tags":
            t = tagging.read_tags(data)
            return [*list(t.values())[:-1], [{"key": k, "value": v} for k, v in t["other"]]]
        from ..functions import spectrum

        rate, channels, samples = probing.decode(data, self.tables)
        target, mono = int(self.options.get("sample_rate", 0)), self.options.get("mono", "false").lower() == "true"
        if mono:
            samples, channels = spectrum.to_mono(samples, channels), 1
        if target and target != rate:
            if channels != 1:
                raise ArgumentError("another sample_rate needs mono")
            samples, rate = spectrum.resample(samples, rate, target), target
        return [rate, channels, len(samples) // channels, samples]


@dataclass
class Wrote(WriterCommitMessage):
    n: int


class AudioWriter(DataSourceWriter):
    """Rows of path (relative) and content as files; each is written aside and moved, so a repeated task leaves whole files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        system, root = _files(self.path)
        n = 0
        for row in iterator:
            if ".." in row["path"].split("/"):
                raise ArgumentError(f"path leaves the folder: {row['path']}")
            target = f"{root}/{row['path']}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            aside = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as f:
                f.write(bytes(row["content"]))
            system.move(aside, target)
            n += 1
        return Wrote(n)


class AudioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return _schema(self.options.get("mode", "decode"))

    def reader(self, schema) -> DataSourceReader:
        return AudioReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return AudioWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AudioSource)


def read_binary(spark: SparkSession, path: str, mode: str = "decode", **more) -> DataFrame:
    """The same rows through Spark's own file reader, for any store that Spark reads."""
    from pyspark.sql import functions as F

    from ..operators import audio

    kernel = {"probe": audio.probed, "tags": audio.tags, "decode": audio.decoded}[mode]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", kernel(F.col("content"), **more).alias("x")).select("path", "x.*")
