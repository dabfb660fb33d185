"""Files that no writer of this library makes, built here bit by bit, and files by blocks and through the data source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import audio
from ..sources import audio_source, mp3, ogg
from ..sources.bits import BitWriter, crc, rice_bits
from ..sources.pcm_files import quantise
from ..streaming import audio as stream
from . import signals

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def _made(df, key: str, columns: list[str], f):
    """key and content: a file made of each row's columns."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [f(*row) for row in zip(*(pdf[c] for c in columns))]})

    return df.select(key, *(c for c in columns if c != key)).mapInPandas(run, f"{key} long, content binary")


# --- MPEG --------------------------------------------------------------------


def _silence(doc_id: int) -> bytes:
    """One to four frames, of either version, mono or stereo, some behind a tag."""
    tag = b"ID3\4\0\0\0\0\0\7comment" if doc_id % 5 == 0 else b""
    return tag + mp3.silent_frames(int(doc_id) % 4 + 1, (44100, 22050)[int(doc_id) % 2], int(doc_id) % 3 % 2 + 1)


_MPEG_SQL = "CASE WHEN doc_id % 2 = 0 THEN 44100 ELSE 22050 END AS sample_rate, CAST(doc_id % 3 % 2 + 1 AS INTEGER) AS channels"


@_query(f"SELECT doc_id, {_MPEG_SQL}, CAST((doc_id % 4 + 1) * CASE WHEN doc_id % 2 = 0 THEN 1152 ELSE 576 END AS BIGINT) AS frames, CAST((doc_id % 4 + 1) * CASE WHEN doc_id % 2 = 0 THEN 1152 ELSE 576 END * (doc_id % 3 % 2 + 1) AS INTEGER) AS n, 0.0::DOUBLE AS peak FROM documents")
def mp3_silence(spark, sf_dir):
    """Frames without a spectrum, decoded."""
    back = _made(_ids(spark, sf_dir), "doc_id", ["doc_id"], _silence).select("doc_id", audio.decoded(F.col("content"), mode="failfast").alias("b"))
    return back.select("doc_id", "b.sample_rate", "b.channels", F.col("b.frames").cast("long").alias("frames"), F.size("b.samples").alias("n"), F.array_max(F.transform("b.samples", F.abs)).cast("double").alias("peak"))


@_query(f"SELECT doc_id, 'mp3' AS container, 'mp3' AS codec, {_MPEG_SQL}, false AS frames_known FROM documents UNION ALL SELECT doc_id, 'ogg', 'vorbis', 8000, 1, false FROM documents")
def stream_probes(spark, sf_dir):
    """Probes of MPEG and Ogg files."""
    ids = _ids(spark, sf_dir)
    made = _made(ids, "doc_id", ["doc_id"], _silence).unionByName(_made(ids, "doc_id", ["doc_id"], lambda _: ogg.write_stream(_vorbis_heads())))
    return made.select("doc_id", audio.probed(F.col("content"), mode="failfast").alias("p")).select("doc_id", "p.container", "p.codec", "p.sample_rate", "p.channels", "p.frames_known")


@_query("SELECT doc_id, 'mp3: layer ' || (doc_id % 2 + 1) || ' is another codec, which is not decoded' AS message FROM documents")
def refused_layers(spark, sf_dir):
    """Layers I and II are refused by name."""
    made = _made(_ids(spark, sf_dir), "doc_id", ["doc_id"], lambda i: bytes([0xFF, 0xE1 | 3 << 3 | (3 if i % 2 == 0 else 2) << 1, 0x90, 0]) + bytes(100))
    return made.select("doc_id", audio.decoded(F.col("content")).alias("b")).select("doc_id", "b.error.message")


# --- Vorbis ------------------------------------------------------------------


class _Low:
    """Bits from the lowest."""

    def __init__(self):
        self.value = self.count = 0

    def put(self, *fields: tuple[int, int]) -> _Low:
        for value, count in fields:
            self.value |= value << self.count
            self.count += count
        return self

    def done(self) -> bytes:
        return self.value.to_bytes(-(-self.count // 8), "little")


def _vorbis_heads(rate: int = 8000) -> list[bytes]:
    """Headers of a mono stream of blocks of 64, whose spectra are made of -1 and 1 under a flat floor."""
    float32 = lambda sign, exponent, mantissa: (sign << 31 | exponent << 21 | mantissa, 32)
    first = _Low().put((0, 32), (1, 8), (rate, 32), (0, 96), (6, 4), (6, 4), (1, 8))
    book = [(0, 8), (0x564342, 24), (1, 16), (2, 24), (0, 1), (0, 1), (0, 5), (0, 5), (1, 4), float32(1, 788, 1), float32(0, 788, 2), (0, 4), (0, 1), (0, 1), (1, 1)]
    floor = [(0, 6), (0, 16), (0, 6), (1, 16), (0, 5), (0, 2), (5, 4)]
    residue = [(0, 6), (1, 16), (0, 24), (32, 24), (31, 24), (0, 6), (0, 8), (1, 3), (0, 1), (0, 8)]
    rest = [(0, 6), (0, 16), (0, 1), (0, 1), (0, 2), (0, 8), (0, 8), (0, 8), (0, 6), (0, 1), (0, 16), (0, 16), (0, 8), (1, 1)]
    return [b"\x01vorbis" + first.done(), b"\x03vorbis" + bytes(8) + b"\x01", b"\x05vorbis" + _Low().put(*book, *floor, *residue, *rest).done()]


def _vorbis_block(signs) -> bytes:
    return _Low().put((0, 1), (1, 1), (255, 8), (255, 8), (0, 1), *((int(s), 1) for s in signs)).done()


def _vorbis_file(samples) -> bytes:
    up = np.asarray(samples) > 0
    return ogg.write_stream([*_vorbis_heads(), _vorbis_block(up[:32]), _vorbis_block(up[32:])])


@_query(
    "WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), b AS (SELECT vec_id, i // 32 AS block, i % 32 AS k, CASE WHEN CAST(x AS FLOAT) > 0 THEN 1 ELSE -1 END AS v FROM s), "
    "p AS (SELECT unnest(range(0, 32)) AS pos), t AS (SELECT pos, block, pos + 32 * (1 - block) AS n FROM p, (SELECT unnest([0, 1]) AS block)), "
    "f AS (SELECT t.pos, b.block, b.k, sin(pi() / 2 * pow(sin((t.n + 0.5) / 64 * pi()), 2)) * cos(pi() / 128 * (2 * t.n + 33) * (2 * b.k + 1)) AS c FROM t JOIN (SELECT DISTINCT block, k FROM b) AS b ON t.block = b.block) "
    "SELECT b.vec_id, CAST(f.pos AS INTEGER) AS pos, CAST(round(CAST(CAST(least(greatest(sum(b.v * f.c), -1), 1) AS FLOAT) AS DOUBLE) * 32768) AS BIGINT) AS code FROM b JOIN f ON b.block = f.block AND b.k = f.k GROUP BY b.vec_id, f.pos"
)
def vorbis_spectra(spark, sf_dir):
    """Two blocks of known spectra: the sum of their windowed inverse transforms, where they overlap."""
    rows = signals.emb_rows(spark, sf_dir)
    back = _made(rows, "vec_id", ["samples"], _vorbis_file).select("vec_id", audio.decoded(F.col("content"), mode="failfast").alias("b"))
    return back.select("vec_id", F.posexplode("b.samples").alias("pos", "value")).select("vec_id", "pos", F.round(F.col("value").cast("double") * 32768).cast("long").alias("code"))


# --- FLAC frames of other encoders -------------------------------------------


def _subframe(w: BitWriter, x: np.ndarray, bits: int, kind: int) -> None:
    """Kind 0: two taps (3 x[-1] - x[-2]) / 2 and Rice codes with parameters of five bits in two partitions. 1: one tap, and a partition that
    escapes to plain numbers. 2: verbatim, with wasted bits where there are any."""
    n, wasted = len(x), 0
    if kind == 2:
        while wasted < bits - 1 and not (x & ((2 << wasted) - 1)).any():
            wasted += 1
        w.put(1 << 1 | (wasted > 0), 8)
        if wasted:
            w.put(1, wasted)
        w.put_many(x >> wasted, bits - wasted)
        return
    order, taps, shift = ((2, (3, -1), 1), (1, (1,), 0))[kind]
    w.put((31 + order) << 1, 8)
    w.put_many(x[:order], bits)
    w.put(4 - 1, 4)
    w.put_signed(shift, 5)
    w.put_many(np.array(taps), 4)
    guess = sum(t * x[order - 1 - j : n - 1 - j] for j, t in enumerate(taps)) >> shift
    errors = x[order:] - guess
    if kind == 0:
        sizes = [n // 2 - order, n // 2]
        w.put(1, 2)
        w.put(1, 4)
        w.put_bits(rice_bits(errors << 1 ^ errors >> 63, sizes, [17, 16], 5))
    else:
        w.put(0, 2)
        w.put(0, 4)
        w.put(15, 4)
        w.put(bits + 2, 5)
        w.put_many(errors, bits + 2)


def _flac_file(vec_id: int, samples) -> bytes:
    """Stereo, 16 bits, frames of 16 samples numbered from 126: left with its reverse, in one of the four channel assignments, by turns."""
    code = quantise(np.asarray(samples, np.float32), 16).astype(np.int64)
    left, right = code, code[::-1] & ~7  # three wasted bits
    frames, size = [], 16
    for number, at in enumerate(range(0, len(code), size)):
        a, b = left[at : at + size], right[at : at + size]
        assignment = (int(vec_id) + number) % 4
        planes = [(a, 16), (b, 16)], [(a, 16), (a - b, 17)], [(a - b, 17), (b, 16)], [((a + b) >> 1, 16), (a - b, 17)]
        w = BitWriter()
        w.put(0x3FFE << 2, 16)
        w.put(6 << 4 | 4, 8)
        w.put((1, 8, 9, 10)[assignment] << 4 | 4 << 1, 8)
        counted = 126 + number  # one byte up to 127, then two
        w.put(counted, 8) if counted < 128 else w.put(0xC080 | counted >> 6 << 8 | counted & 63, 16)
        w.put(size - 1, 8)
        w.put(crc(w.to_bytes(), 8), 8)
        for j, (plane, bits) in enumerate(planes[assignment]):
            _subframe(w, plane, bits, (int(vec_id) + number // 4 + j) % 3)
        w.align()
        body = w.to_bytes()
        frames.append(body + crc(body, 16).to_bytes(2, "big"))
    info = size.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | len(code)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


_CODE_SQL = "CAST(least(greatest(round(CAST(CAST(CAST(x AS FLOAT) * CAST(32768 AS FLOAT) AS FLOAT) AS DOUBLE)), -32768), 32767) AS BIGINT)"


@_query(
    f"WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT vec_id, i, {_CODE_SQL} AS c FROM s) "
    "SELECT vec_id, 2 * i AS pos, CAST(c / 32768.0::DOUBLE AS FLOAT) AS value FROM c UNION ALL SELECT vec_id, 2 * (63 - i) + 1, CAST((c - ((c % 8) + 8) % 8) / 32768.0::DOUBLE AS FLOAT) FROM c"
)
def flac_predictors(spark, sf_dir):
    """Frames with linear prediction, side channels, wasted bits, escaped partitions and long frame numbers."""
    rows = signals.emb_rows(spark, sf_dir)
    back = _made(rows, "vec_id", ["vec_id", "samples"], _flac_file).select("vec_id", audio.decoded(F.col("content"), mode="failfast").alias("b"))
    return back.select("vec_id", F.posexplode("b.samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


# --- blocks, folders, rates --------------------------------------------------

PER_FILE = 50


@_query(f"WITH s AS (SELECT vec_id // {PER_FILE} AS recording_id, vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings) SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY vec_id, i) - 1 AS pos, CAST({_CODE_SQL} / 32768.0::DOUBLE AS FLOAT) AS value FROM s")
def wav_blocks(spark, sf_dir):
    """A stream of blocks, written to WAV files block by block, and decoded."""
    path = signals.shared_path(spark, "wav-blocks")
    rows = signals.emb_rows(spark, sf_dir).select(F.floor(F.col("vec_id") / PER_FILE).cast("long").alias("recording_id"), F.col("vec_id").alias("block_no"), "samples")
    rows.write.parquet(f"{path}/blocks")
    source = spark.readStream.schema("recording_id long, block_no long, samples array<float>").parquet(f"{path}/blocks")
    q = stream.wave_blocks(source, f"{path}/parts", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    files = stream.finish_waves(spark, f"{path}/parts", 8000, 1)
    back = files.select("recording_id", audio.decoded(F.col("content"), mode="failfast").alias("b"))
    return back.select("recording_id", F.posexplode("b.samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


_KINDS = ("wav", "flac", "alac", "aiff")


@_query(
    "SELECT n AS vec_id, mode, CASE mode WHEN 'tags' THEN NULL ELSE 8000 END AS sample_rate, CASE mode WHEN 'tags' THEN NULL ELSE 2 END AS channels, CASE mode WHEN 'tags' THEN NULL ELSE CAST(32 AS BIGINT) END AS frames "
    "FROM (SELECT vec_id AS n FROM embeddings), (SELECT unnest(['probe', 'tags', 'decode']) AS mode)"
)
def audio_folder(spark, sf_dir):
    """Files of four kinds, written by the sink and read by the source in its three modes."""
    audio_source.register(spark)
    path = signals.shared_path(spark, "audio-folder")
    rows = signals.emb_rows(spark, sf_dir)
    coded = [audio.encoded(F.col("samples"), F.col("sample_rate"), F.lit(2), k) for k in _KINDS]
    content = F.coalesce(*(F.when(F.col("vec_id") % 4 == i, c) for i, c in enumerate(coded)))
    rows.select(F.concat(F.lit("part"), F.col("vec_id") % 7, F.lit("/"), F.col("vec_id"), F.lit(".bin")).alias("path"), content.alias("content")).write.format("audio").mode("append").save(path)
    out = None
    for mode in ("probe", "tags", "decode"):
        read = spark.read.format("audio").option("mode", mode).option("bytes_per_task", 1 << 18).load(path).where("error is null")
        none = F.lit(None)
        fields = [none.cast("int"), none.cast("int"), none.cast("long")] if mode == "tags" else [F.col("sample_rate").cast("int"), F.col("channels").cast("int"), F.col("frames").cast("long")]
        part = read.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("vec_id"), F.lit(mode).alias("mode"), *(f.alias(n) for f, n in zip(fields, ("sample_rate", "channels", "frames"))))
        out = part if out is None else out.unionByName(part)
    return out


@_query(
    f"WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT vec_id, i, CAST({_CODE_SQL} / 32768.0::DOUBLE AS FLOAT) AS v FROM s), "
    "m AS (SELECT vec_id, i // 2 AS n, CAST(sum(CAST(v AS DOUBLE)) / 2 AS FLOAT) AS v FROM c GROUP BY vec_id, i // 2), o AS (SELECT unnest(range(0, 16)) AS pos) "
    "SELECT m.vec_id, o.pos, m.v AS value FROM m JOIN o ON m.n = 2 * o.pos"
)
def decode_at_half_the_rate(spark, sf_dir):
    """Stereo files, decoded to mono at half their rate: every other mean."""
    rows = signals.emb_rows(spark, sf_dir)
    coded = rows.select("vec_id", audio.encoded(F.col("samples"), F.col("sample_rate"), F.lit(2), "wav", 16).alias("content"))
    back = coded.select("vec_id", audio.decoded(F.col("content"), rate=4000, mono=True, mode="failfast").alias("b"))
    return back.select("vec_id", F.posexplode("b.samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
