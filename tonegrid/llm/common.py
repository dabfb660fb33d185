"""Helpers that all operators of this folder share."""

from __future__ import annotations

import contextvars
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python; a text beyond these bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 800, 16 << 20
#: Bytes of text that one block (a unit of work in Python) should hold.
BLOCK_BYTES = 24 << 20


def arrow(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for whole texts, by rows and by bytes. The session keeps these settings: plans that are
    run later read them then."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text (null: empty); other columns, whatever their names, are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode (as in tests), else an error."""
    conf = spark.sparkContext.getConf()
    if not (folder := conf.get("spark.checkpoint.dir")):
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            folder = jvm.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="tonegrid-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


class Scratch:
    """Tables in the shared folder that operators make while this is entered. clear() deletes them: for the caller, once whatever was
    computed from them has been consumed. Tables made outside of any stay until their folder is cleared."""

    _entered: contextvars.ContextVar[tuple] = contextvars.ContextVar("entered", default=())

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        self._entered.set((*self._entered.get(), self))
        return self

    def __exit__(self, *_) -> None:
        self._entered.set(self._entered.get()[:-1])

    def clear(self) -> None:
        while self.tables:
            delete(*self.tables.pop())


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it belongs to the Scratch entered last."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if entered := Scratch._entered.get():
        entered[-1].tables.append((spark, path))
    return path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: one scan, one row to the driver."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession, total: int, each: int) -> int:
    """How many partitions hold total bytes by `each`; at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as int64 offsets (from 0) and its bytes as uint8."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the slices [start, start + length), one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants); wraps on purpose."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
