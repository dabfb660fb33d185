"""Recordings as rows: decoding, probing, tags and encoding of a binary column, in Arrow batches.

Errors are values by default: a row whose bytes are wrong gets nulls and an error of status and message. mode="failfast" raises instead."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectrum
from ..model import BAD_FORMAT, BUFFER, ERROR, NUMBER_TAGS, PROBE, TAGS, TEXT_TAGS, ArgumentError, AudioError
from ..sources import alac, flac, layer3, mp4, ogg, pcm_files, probe as probing, tags as tagging

WRITERS = {"wav": pcm_files.write_wave, "flac": flac.write_flac, "alac": alac.write_alac, "aiff": pcm_files.write_aiff}


def _checked(mode: str) -> None:
    if mode not in ("permissive", "failfast"):
        raise ArgumentError(f"mode must be permissive or failfast, not {mode}")


def _guarded(f, content, mode: str) -> tuple:
    """(result, error) of a kernel; anything a hostile file sets off counts as its error."""
    if content is None:
        return None, None
    try:
        return f(bytes(content)), None
    except AudioError as e:
        if mode == "failfast":
            raise
        return None, {"status": e.status, "message": str(e)}
    except (IndexError, ValueError, OverflowError, MemoryError, ArithmeticError) as e:
        if mode == "failfast":
            raise AudioError(str(e)) from e
        return None, {"status": BAD_FORMAT, "message": f"malformed: {e}"}


def decoded(content: Column, rate: int = 0, mono: bool = False, mode: str = "permissive", mp3_tables: str = "") -> Column:
    """struct<sample_rate, channels, frames, samples, error>: mono first, then another rate, where asked for. mp3_tables: the
    driver's path of the file with layer 3's tables (sources/layer3.py), which goes to the tasks."""
    _checked(mode)
    tables = layer3.load_tables(mp3_tables) if mp3_tables else None

    def one(raw: bytes, found=None):
        own, channels, samples = found or probing.decode(raw, tables)
        if mono or (rate and rate != own):
            planes = [spectrum.to_mono(samples, channels)] if mono else [samples[c::channels] for c in range(channels)]
            planes = [spectrum.resample(p, own, rate or own) for p in planes]
            own, channels, samples = rate or own, len(planes), np.stack(planes, 1).reshape(-1)
        return own, channels, len(samples) // channels, samples

    @F.pandas_udf(f"{BUFFER}, error {ERROR}")
    def run(content: pd.Series) -> pd.DataFrame:
        # Files in MP4 are decoded side by side; those that fail go the plain way, which tells why.
        at = [i for i, c in enumerate(content) if c is not None and probing.sniff(bytes(c[:16])) == "mp4"]
        ready = {i: f for i, f in zip(at, alac.read_many([bytes(content.iloc[i]) for i in at])) if not isinstance(f, AudioError)}
        rows = [_guarded(lambda raw, i=i: one(raw, ready.get(i)), c, mode) for i, c in enumerate(content)]
        found = [r if r else (None,) * 4 for r, _ in rows]
        return pd.DataFrame({n: pd.Series([r[i] for r in found], dtype=object) for i, n in enumerate(("sample_rate", "channels", "frames", "samples"))} | {"error": pd.Series([e for _, e in rows], dtype=object)})

    return run(content)


def probed(content: Column, exact: bool = False, mode: str = "permissive") -> Column:
    """struct<container, codec, sample_rate, channels, frames, frames_known, error>; exact decodes everything and counts."""
    _checked(mode)
    names = [x.split()[0] for x in PROBE.split(", ")]

    @F.pandas_udf(f"{PROBE}, error {ERROR}")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [_guarded(probing.exact if exact else probing.probe, c, mode) for c in content]
        return pd.DataFrame({n: pd.Series([r[n] if r else None for r, _ in rows], dtype=object) for n in names} | {"error": pd.Series([e for _, e in rows], dtype=object)})

    return run(content)


def tags(content: Column) -> Column:
    """The tags of any container as a struct; bytes without any give empty ones."""

    @F.pandas_udf(TAGS)
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [_guarded(tagging.read_tags, c, "permissive")[0] or tagging.empty() for c in content]
        out = {n: [r[n] for r in rows] for n in (*TEXT_TAGS, *NUMBER_TAGS)}
        return pd.DataFrame(out | {"other": [[{"key": k, "value": v} for k, v in r["other"]] for r in rows]})

    return run(content)


def encoded(samples: Column, rate: Column, channels: Column, kind: str = "wav", bits: int = 16) -> Column:
    """The file's bytes, as wav, flac or alac (in MP4); arguments are checked by the writer, before any work."""
    if kind not in WRITERS:
        raise ArgumentError(f"no writer for {kind}")
    write = WRITERS[kind]

    @F.pandas_udf("binary")
    def run(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else write(np.asarray(s, np.float32), int(r), int(c), bits) for s, r, c in zip(samples, rate, channels)], dtype=object)

    return run(samples, rate, channels)


def fingerprints(df: DataFrame, content: str = "content") -> DataFrame:
    """df with fingerprint and chroma (struct<duration, words>) of a binary column."""
    buffers = df.withColumn("__b", decoded(F.col(content)))
    ready = buffers.where("__b.samples is not null")
    args = [F.col("__b.samples"), F.col("__b.sample_rate"), F.col("__b.channels")]
    return ready.withColumns({"fingerprint": spectrum.fingerprint_udf()(*args), "chroma": spectrum.chroma_udf()(*args)}).drop("__b")


def ogg_packets(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row for each packet: key, serial, packet_no, data, granule, ends_stream. Files that aren't whole Ogg give none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content]):
                found, _ = _guarded(ogg.streams, c, "permissive")
                rows += [(k, serial, n, p["data"], p["granule"], p["ends"]) for serial, packets in (found or {}).items() for n, p in enumerate(packets)]
            yield pd.DataFrame(rows, columns=[key, "serial", "packet_no", "data", "granule", "ends_stream"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, serial long, packet_no int, data binary, granule long, ends_stream boolean")


def mp4_boxes(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row for each box at any depth that holds boxes: key, path, start, end."""
    inner = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"dinf"}

    def walk(data: bytes, at: int, end: int, path: str, depth: int):
        for kind, body, stop in mp4.boxes(data, at, end):
            name = f"{path}/{kind.decode('latin-1')}"
            yield name, body, stop
            if kind in inner and depth < mp4.MAX_DEPTH:
                yield from walk(data, body, stop, name, depth + 1)

    def run(batches):
        for pdf in batches:
            rows = [(k, *found) for k, c in zip(pdf[key], pdf[content]) if c is not None for found in walk(bytes(c), 0, len(c), "", 0)]
            yield pd.DataFrame(rows, columns=[key, "path", "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, path string, start long, end long")


def mp4_tables(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, chunks (offsets), runs (first_chunk, per_chunk) and sizes of the first audio track."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content]):
                t, _ = _guarded(mp4.track_tables, c, "permissive")
                if t:
                    rows.append((k, t["chunks"], [{"first_chunk": a, "per_chunk": b} for a, b in t["runs"]], t["sizes"]))
            yield pd.DataFrame(rows, columns=[key, "chunks", "runs", "sizes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, chunks array<long>, runs array<struct<first_chunk: long, per_chunk: long>>, sizes array<long>")
