"""Sample arithmetic as columns: everything stays in the JVM.

FLOAT columns widen to DOUBLE in most Spark arithmetic; results are narrowed where the data model has 32-bit samples. Only
sums, differences and products of two FLOATs stay FLOAT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONTAINERS, MAX_CHANNELS, MAX_RATE


def _float(x: Column) -> Column:
    return x.cast("float")


def from_pcm8(code: Column) -> Column:
    """Unsigned 8-bit code to a sample."""
    return _float((code.cast("double") - 128) / 128)


def from_pcm16(code: Column) -> Column:
    return _float(code.cast("double") / 32768)


def from_pcm24(low: Column, middle: Column, high: Column) -> Column:
    """Three little-endian bytes to a sample."""
    raw = low.cast("int").bitwiseOR(F.shiftleft(middle.cast("int"), 8)).bitwiseOR(F.shiftleft(high.cast("int"), 16))
    return _float(F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw).cast("double") / (1 << 23))


def from_pcm32(code: Column) -> Column:
    return _float(code.cast("double") / 2147483648.0)


def quantise(sample: Column, bits: int) -> Column:
    """Nearest code, halves away from zero, clamped to the range of `bits`."""
    scale = 1 << (bits - 1)
    scaled = _float(_float(sample) * F.lit(float(scale)).cast("float")).cast("double")
    near = F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)
    return F.least(F.greatest(near, F.lit(float(-scale))), F.lit(float(scale - 1))).cast("long")


def sample_at(samples: Column, channels: Column, frame: Column, channel: Column) -> Column:
    """The sample of a frame and channel, or null outside."""
    inside = (frame >= 0) & (channel >= 0) & (channel < channels)
    return F.when(inside, F.try_element_at(samples, (frame * channels + channel + 1).cast("int")))


def to_mono(samples: Column, channels: Column) -> Column:
    """The mean over channels: summed in 32 bits in channel order; mono stays as it is."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    zero = F.lit(0.0).cast("float")
    mean = lambda i: _float(F.aggregate(F.slice(samples, i * channels + 1, channels), zero, lambda s, x: s + x).cast("double") / channels)
    many = F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)) - 1), mean)).otherwise(F.array().cast("array<float>"))
    return F.when(channels == 1, samples).otherwise(many)


def resample(samples: Column, channels: Column, source: Column, target: Column) -> Column:
    """Linear interpolation to another rate; the same rate leaves samples as they are."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    ratio = source.cast("double") / target.cast("double")
    n = F.floor(frames.cast("double") / ratio).cast("int")

    def value(i: Column) -> Column:
        frame, channel = F.floor(i / channels).cast("int"), F.pmod(i, channels)
        at = frame.cast("double") * ratio
        left = F.floor(at).cast("int")
        right = F.least(left + 1, frames - 1)
        a = F.element_at(samples, left * channels + channel + 1)
        b = F.element_at(samples, right * channels + channel + 1)
        return a + (b - a) * _float(at - left)

    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n * channels, F.lit(1)) - 1), value)).otherwise(F.array().cast("array<float>"))
    return F.when(source == target, samples).otherwise(made)


def deinterleave(samples: Column, channels: Column) -> Column:
    """An array of one array of samples per channel."""
    every = lambda c: F.filter(samples, lambda x, i: F.pmod(i, channels) == c)
    return F.transform(F.sequence(F.lit(0), channels - 1), every)


def interleave(planes: Column) -> Column:
    """The inverse of deinterleave(): planes of equal length become frames."""
    frames = F.size(F.element_at(planes, 1))
    made = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), lambda f: F.transform(planes, lambda p: F.element_at(p, f))))
    return F.when(frames > 0, made).otherwise(F.array().cast("array<float>"))


def clamp(sample: Column) -> Column:
    return F.least(F.greatest(sample, F.lit(-1.0).cast("float")), F.lit(1.0).cast("float"))


def sample_count(frames: Column, channels: Column) -> Column:
    return frames.cast("long") * channels


def duration_seconds(frames: Column, rate: Column) -> Column:
    """Frames over rate: channels don't lengthen a recording; 0 for a rate of 0."""
    return F.when(rate > 0, frames.cast("double") / rate).otherwise(F.lit(0.0))


def silence(channels: Column, frames: Column) -> Column:
    """A zeroed buffer."""
    return F.array_repeat(F.lit(0.0).cast("float"), (channels * frames).cast("int"))


def is_valid(rate: Column, channels: Column, frames: Column) -> Column:
    return rate.between(1, MAX_RATE) & channels.between(1, MAX_CHANNELS) & (frames >= 0)


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def sniff(content: Column) -> Column:
    """The container by its first bytes, never by a name."""
    at = lambda offset, text: F.substring(content, offset + 1, len(text)) == F.lit(text.encode("latin-1"))
    first = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int")
    second = F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int")
    return (
        F.when(F.octet_length(content) < 4, "unknown")
        .when(at(0, "RIFF") & at(8, "WAVE"), "wav")
        .when(at(0, "FORM") & (at(8, "AIFF") | at(8, "AIFC")), "aiff")
        .when(at(0, "fLaC"), "flac")
        .when(at(0, "OggS"), "ogg")
        .when(at(4, "ftyp"), "mp4")
        .when(at(0, "ID3") | ((first == 0xFF) & (second.bitwiseAND(0xE0) == 0xE0)), "mp3")
        .otherwise("unknown")
    )


def decodes(container: Column) -> Column:
    return container != "unknown"


def container_name(code: Column) -> Column:
    return F.coalesce(F.when(code >= 0, F.try_element_at(F.array(*map(F.lit, CONTAINERS)), code.cast("int") + 1)), F.lit("unknown"))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x.cast("long"), 1).bitwiseXOR(F.shiftright(x.cast("long"), 63))
