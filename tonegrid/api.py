"""The whole surface in one place: columns for DataFrames, and functions on bytes and arrays for single files.

Columns: sniff, decodes, probe, decode, tags, encode_wav, encode_flac, encode_alac, fingerprint, chroma_fingerprint, similarity,
offset_similarity. Files: file_* and WaveWriter. Errors: AudioError with a status (1 argument, 2 input or output, 3 format)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column

from . import __version__
from .functions import pcm, spectrum
from .functions import similarity as _similarity
from .model import BAD_IO, MAX_CHANNELS, ArgumentError, AudioError
from .operators import audio
from .sources import layer3, pcm_files, probe as _probe, tags as _tags
from .sources.audio_source import read_binary, register
from .sources.pcm_files import WaveWriter

sniff, decodes, container_name = pcm.sniff, pcm.decodes, pcm.container_name
probe, decode, tags = audio.probed, audio.decoded, audio.tags
similarity, offset_similarity = _similarity.similarity, _similarity.offset_similarity
#: Both fingerprints' words are compared alike.
chroma_similarity = similarity


def version() -> str:
    return __version__


def encode_wav(samples: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    return audio.encoded(samples, rate, channels, "wav", bits)


def encode_flac(samples: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    return audio.encoded(samples, rate, channels, "flac", bits)


def encode_alac(samples: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    return audio.encoded(samples, rate, channels, "alac", bits)


def fingerprint(samples: Column, rate: Column, channels: Column) -> Column:
    return spectrum.fingerprint_udf()(samples, rate, channels)


def chroma_fingerprint(samples: Column, rate: Column, channels: Column) -> Column:
    return spectrum.chroma_udf()(samples, rate, channels)


class ReadError(AudioError):
    """A path that can't be opened, as against bytes that are wrong."""

    status = BAD_IO


def _bytes(path: str) -> bytes:
    if not path:
        raise ArgumentError("an empty path")
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise ReadError(f"cannot open {path}: {e.strerror}") from e


def file_sniff(path: str) -> str:
    """The container, from the first bytes."""
    if not path:
        raise ArgumentError("an empty path")
    try:
        with open(path, "rb") as f:
            return _probe.sniff(f.read(16))
    except OSError as e:
        raise ReadError(f"cannot open {path}: {e.strerror}") from e


def _tables(path: str) -> layer3.Tables | None:
    """Layer 3's tables from their file, where one is given."""
    return layer3.load_tables(path) if path else None


def file_probe(path: str, exact: bool = True, mp3_tables: str = "") -> dict:
    data = _bytes(path)
    return _probe.exact(data, _tables(mp3_tables)) if exact else _probe.probe(data)


def file_wave_probe(path: str) -> dict:
    return _probe.probe_wave(_bytes(path))


def file_decode(path: str, rate: int = 0, mono: bool = False, mp3_tables: str = "") -> tuple[int, int, np.ndarray]:
    """rate, channels, interleaved samples; mono before another rate."""
    own, channels, samples = _probe.decode(_bytes(path), _tables(mp3_tables))
    if rate < 0:
        raise ArgumentError(f"sample rate out of range: {rate}")
    if mono:
        samples, channels = spectrum.to_mono(samples, channels), 1
    if rate and rate != own:
        planes = [spectrum.resample(samples[c::channels], own, rate) for c in range(channels)]
        samples, own = np.stack(planes, 1).reshape(-1), rate
    return own, channels, samples


def file_tags(path: str) -> dict:
    """Fields by name; other as a list of (key, value)."""
    return _tags.read_tags(_bytes(path))


def file_fingerprint(path: str, chroma: bool = False, mp3_tables: str = "") -> tuple[float, list[int]]:
    rate, channels, samples = _probe.decode(_bytes(path), _tables(mp3_tables))
    seconds, words = (spectrum.chroma_fingerprint if chroma else spectrum.fingerprint)(samples, rate, channels)
    return seconds, words.tolist()


def words_similarity(a: Sequence[int], b: Sequence[int], max_shift: int = 0) -> float:
    """The best similarity of two word lists over shifts of up to max_shift words."""
    if max_shift < 0:
        raise ArgumentError("max_shift must not be negative")

    def plain(x: Sequence[int], y: Sequence[int]) -> float:
        n = min(len(x), len(y))
        return 1 - sum((p ^ q).bit_count() for p, q in zip(x, y)) / (32 * n) if n else 0.0

    return max(plain(a[s:] if side else a, b if side else b[s:]) for s in range(max_shift + 1) for side in (0, 1))


def write_file(path: str, samples, rate: int, channels: int, kind: str = "wav", bits: int = 16) -> None:
    """samples: flat and interleaved, or rows of one frame each, all equally long."""
    if kind not in ("wav", "flac", "alac"):
        raise ArgumentError(f"no writer for {kind}")
    try:
        flat = np.asarray(samples, np.float32)
    except ValueError as e:
        raise ArgumentError("ragged samples") from e
    if flat.ndim > 2 or (flat.ndim == 2 and flat.shape[1] != channels) or not 1 <= channels <= MAX_CHANNELS:
        raise ArgumentError("samples don't match the channel count")
    data = audio.WRITERS[kind](flat.reshape(-1), rate, channels, bits)
    try:
        with open(path, "wb") as f:
            f.write(data)
    except OSError as e:
        raise ReadError(f"cannot open {path}: {e.strerror}") from e


__all__ = [
    "AudioError", "ArgumentError", "ReadError", "WaveWriter", "chroma_fingerprint", "chroma_similarity", "container_name", "decode", "decodes", "encode_alac", "encode_flac", "encode_wav", "file_decode", "file_fingerprint",
    "file_probe", "file_sniff", "file_tags", "file_wave_probe", "fingerprint", "offset_similarity", "pcm_files", "probe", "read_binary", "register", "similarity", "sniff", "tags", "version", "words_similarity", "write_file",
]
