"""Schemas, limits and codes of the audio data model."""

from __future__ import annotations

#: Limits that decoders enforce.
MAX_RATE = 768_000
MAX_CHANNELS = 64
MAX_CHUNK = 512 << 20

#: Container names by code.
CONTAINERS = ("unknown", "wav", "aiff", "flac", "ogg", "mp3", "mp4")

#: Status codes of errors.
OK, BAD_ARGUMENT, BAD_IO, BAD_FORMAT = 0, 1, 2, 3

ERROR = "struct<status: int, message: string>"
BUFFER = "sample_rate int, channels int, frames long, samples array<float>"
PROBE = "container string, codec string, sample_rate int, channels int, frames long, frames_known boolean"
TEXT_TAGS = ("title", "artist", "album", "albumArtist", "composer", "genre", "comment", "date")
NUMBER_TAGS = ("trackNumber", "trackTotal", "discNumber", "discTotal")
TAGS = ", ".join([f"{n} string" for n in TEXT_TAGS] + [f"{n} int" for n in NUMBER_TAGS] + ["other array<struct<key: string, value: string>>"])


class AudioError(ValueError):
    """Bytes that don't hold what they claim, or a codec that isn't decoded."""

    status = BAD_FORMAT


class ArgumentError(AudioError):
    """A caller's mistake, found before any work."""

    status = BAD_ARGUMENT


def check_shape(rate: int, channels: int, frames: int = 0) -> None:
    if not 1 <= rate <= MAX_RATE:
        raise ArgumentError(f"sample rate out of range: {rate}")
    if not 1 <= channels <= MAX_CHANNELS:
        raise ArgumentError(f"channel count out of range: {channels}")
    if frames < 0:
        raise ArgumentError("negative frame count")
