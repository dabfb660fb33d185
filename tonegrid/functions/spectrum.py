"""Windows, framing, spectra and both fingerprints.

Two forms: column expressions and long tables for SQL users (spectra come from one Arrow kernel over frames; sums, differences, smoothing
and words are DataFrame operations), and whole-buffer kernels in numpy. They agree, and tests hold them against each other."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Both fingerprints' analysis rate, frame and hop; band count and range; pitch range; smoothing; quiet gate.
RATE, FRAME, HOP = 11025, 4096, 1365
BANDS, LOW, HIGH = 33, 300.0, 3000.0
NOTES, NOTE_LOW, NOTE_HIGH = 12, 28, 3520
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
QUIET = 0.01
GRAY = (0, 1, 3, 2)
SPAN = 16
#: The classifiers, in bit order: kind, first class, height, width, three thresholds.
CLASSIFIERS = (
    (0, 4, 3, 15, 1.98215, 2.35817, 2.63523),
    (4, 4, 6, 15, -1.03809, -0.651211, -0.282167),
    (1, 0, 4, 16, -0.298702, 0.119262, 0.558497),
    (3, 8, 2, 12, -0.105439, 0.0153946, 0.135898),
    (3, 4, 4, 8, -0.142891, 0.0258736, 0.200632),
    (4, 0, 3, 5, -0.826319, -0.590612, -0.368214),
    (1, 2, 2, 9, -0.557409, -0.233035, 0.0534525),
    (2, 7, 3, 4, -0.0646826, 0.00620476, 0.0784847),
    (2, 6, 2, 16, -0.192387, -0.029699, 0.215855),
    (2, 1, 3, 2, -0.0397818, -0.00568076, 0.0292026),
    (5, 10, 1, 15, -0.53823, -0.369934, -0.190235),
    (3, 6, 2, 10, -0.124877, 0.0296483, 0.139239),
    (2, 1, 1, 14, -0.101475, 0.0225617, 0.231971),
    (3, 5, 6, 4, -0.0799915, -0.00729616, 0.063262),
    (1, 9, 2, 12, -0.272556, 0.019424, 0.302559),
    (3, 4, 2, 14, -0.164292, -0.0321188, 0.0846339),
)


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1))) if n > 1 else np.ones(n)


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def hann_column(n: Column) -> Column:
    """The window as an array column."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(0.5) * (1 - F.cos(F.lit(2 * math.pi) * i / (n - 1))))


def hamming_column(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * i / (n - 1)))


def band_edges() -> list[int]:
    """Bins at which bands begin, and where the last ends: equal musical intervals."""
    return [int(math.floor(LOW * (HIGH / LOW) ** (i / BANDS) * FRAME / RATE + 0.5)) for i in range(BANDS + 1)]


def note_of(frequency: float) -> int:
    """Pitch class from A."""
    octave = math.log(frequency / 27.5) / math.log(2.0)
    return int(NOTES * (octave - math.floor(octave)))


def note_range() -> range:
    return range(max(1, int(NOTE_LOW * FRAME / RATE)), min(FRAME // 2, int(NOTE_HIGH * FRAME / RATE)))


def note_column(frequency: Column) -> Column:
    octave = F.ln(frequency / 27.5) / F.ln(F.lit(2.0))
    return (F.lit(NOTES) * (octave - F.floor(octave))).cast("int")


def power_spectra(frames: np.ndarray, window: np.ndarray) -> np.ndarray:
    """|FFT|^2 of windowed frames (rows): the lower half of the bins."""
    n = frames.shape[1]
    spectrum = np.fft.rfft(frames.astype(np.float64) * window, axis=1)[:, : n // 2]
    return spectrum.real**2 + spectrum.imag**2


def power_udf(window: str = "hann"):
    """A vectorised function: array of samples (a power of two long) to its power spectrum. Null samples add nothing; of nothing
    else, the spectrum is null. Samples that aren't numbers stay so: Arrow's own arrays tell them from nulls, pandas doesn't."""

    @F.arrow_udf("array<double>")
    def power(samples: pa.Array) -> pa.Array:
        out, absent, ends = [], [], [0]
        for x in samples:
            x, n = x.values, len(x.values) if x.is_valid else 0
            if x is not None and (n < 1 or n & (n - 1)):
                raise ValueError(f"{n} samples: a power of two is needed")
            absent.append(x is None or x.null_count == n)
            if not absent[-1]:
                out.append(power_spectra(x.fill_null(0).to_numpy(zero_copy_only=False)[None], hann(n) if window == "hann" else hamming(n))[0])
            ends.append(ends[-1] if absent[-1] else ends[-1] + n // 2)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out or [np.zeros(0)])), mask=pa.array(absent, pa.bool_()))

    return power


# --- whole buffers ---------------------------------------------------------


def to_mono(samples: np.ndarray, channels: int) -> np.ndarray:
    if channels == 1:
        return samples
    planes = samples[: len(samples) // channels * channels].reshape(-1, channels)
    total = np.zeros(len(planes), np.float32)
    for c in range(channels):
        total += planes[:, c]
    return (total.astype(np.float64) / channels).astype(np.float32)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation of a mono signal."""
    if source == target:
        return samples
    ratio = source / target
    n = int(len(samples) / ratio)
    if not n:
        return np.zeros(0, np.float32)
    at = np.arange(n) * ratio
    left = at.astype(np.int64)
    right = np.minimum(left + 1, len(samples) - 1)
    weight = (at - left).astype(np.float32)
    return samples[left] + (samples[right] - samples[left]) * weight


def framed(mono: np.ndarray) -> np.ndarray:
    if len(mono) < FRAME:
        return np.zeros((0, FRAME), np.float32)
    return np.lib.stride_tricks.sliding_window_view(mono, FRAME)[::HOP]


def _spectra(mono: np.ndarray, window: np.ndarray):
    """Power spectra, some frames at a time, so that long recordings stay small."""
    frames = framed(mono)
    for at in range(0, len(frames), 256):
        yield power_spectra(frames[at : at + 256], window)


def band_words(mono: np.ndarray) -> np.ndarray:
    """Words of a mono signal at RATE: bit i tells whether the fall from band i to i + 1 grew since the frame before."""
    if len(mono) < FRAME + HOP:
        return np.zeros(0, np.int64)
    edges = np.minimum(band_edges(), FRAME // 2)
    energy = np.concatenate([np.stack([p[:, a:b].sum(1) for a, b in zip(edges[:-1], edges[1:])], 1) for p in _spectra(mono, hann(FRAME))])
    fall = energy[:, :-1] - energy[:, 1:]
    bits = (fall[1:] - fall[:-1]) > 0
    return (bits.astype(np.int64) << np.arange(BANDS - 1)).sum(1)


def fingerprint(samples: np.ndarray, rate: int, channels: int) -> tuple[float, np.ndarray]:
    """Seconds at the original rate, and band words."""
    return len(samples) // channels / rate, band_words(resample(to_mono(samples, channels), rate, RATE))


def chroma_energies(mono: np.ndarray) -> np.ndarray:
    bins = note_range()
    notes = np.array([note_of(b * RATE / FRAME) for b in bins])
    chosen = [np.flatnonzero(notes == n) + bins.start for n in range(NOTES)]
    return np.concatenate([np.stack([p[:, own].sum(1) for own in chosen], 1) for p in _spectra(mono, hamming(FRAME))] or [np.zeros((0, NOTES))])


def chroma_rows(energies: np.ndarray) -> np.ndarray:
    """Smoothed over five frames, then to unit length; quiet rows are zero."""
    if len(energies) < len(SMOOTH):
        return np.zeros((0, NOTES))
    n = len(energies) - len(SMOOTH) + 1
    smooth = sum(energies[k : k + n] * c for k, c in enumerate(SMOOTH))
    norm = np.sqrt((smooth * smooth).sum(1))
    return np.where(norm[:, None] < QUIET, 0.0, smooth / np.where(norm, norm, 1)[:, None])


def _areas(rows: np.ndarray):
    """Sums over rectangles of rows [x + a, x + b) and classes [c, d), for every x with SPAN rows."""
    total = np.zeros((len(rows) + 1, NOTES + 1))
    total[1:, 1:] = rows.cumsum(0).cumsum(1)
    n = len(rows) - SPAN + 1

    def area(a: int, b: int, c: int, d: int) -> np.ndarray:
        return total[b : b + n, d] - total[a : a + n, d] - total[b : b + n, c] + total[a : a + n, c]

    return area


def rectangles(kind: int, y: int, h: int, w: int) -> tuple[list, list]:
    """The rectangles (rows from, to, classes from, to) whose sums a classifier of this kind sets against each other."""
    if kind == 0:
        return [(0, w, y, y + h)], []
    if kind == 1:
        return [(0, w, y + h // 2, y + h)], [(0, w, y, y + h // 2)]
    if kind == 2:
        return [(w // 2, w, y, y + h)], [(0, w // 2, y, y + h)]
    if kind == 3:
        x, z = w // 2, y + h // 2
        return [(0, x, z, y + h), (x, w, y, z)], [(0, x, y, z), (x, w, z, y + h)]
    if kind == 4:
        z = h // 3
        return [(0, w, y + z, y + 2 * z)], [(0, w, y, y + z), (0, w, y + 2 * z, y + h)]
    x = w // 3
    return [(x, 2 * x, y, y + h)], [(0, x, y, y + h), (2 * x, w, y, y + h)]


def chroma_words(mono: np.ndarray) -> np.ndarray:
    rows = chroma_rows(chroma_energies(mono))
    if len(rows) < SPAN:
        return np.zeros(0, np.int64)
    area = _areas(rows)
    words = np.zeros(len(rows) - SPAN + 1, np.int64)
    for kind, y, h, w, t0, t1, t2 in CLASSIFIERS:
        plus, minus = (sum((area(*r) for r in side), np.zeros(len(words))) for side in rectangles(kind, y, h, w))
        value = np.log((1 + plus) / (1 + minus))
        level = np.where(value < t1, np.where(value < t0, 0, 1), np.where(value < t2, 2, 3))
        words = words << 2 | np.array(GRAY)[level]
    return words


def chroma_fingerprint(samples: np.ndarray, rate: int, channels: int) -> tuple[float, np.ndarray]:
    return len(samples) // channels / rate, chroma_words(resample(to_mono(samples, channels), rate, RATE))


def _fingerprint_udf(kind):
    @F.pandas_udf("duration double, words array<long>")
    def run(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = [kind(np.asarray(s, np.float32), int(r), int(c)) for s, r, c in zip(samples, rate, channels)]
        return pd.DataFrame({"duration": [d for d, _ in rows], "words": [w for _, w in rows]})

    return run


def fingerprint_udf():
    """Columns samples, sample_rate, channels to struct<duration, words>."""
    return _fingerprint_udf(fingerprint)


def chroma_udf():
    return _fingerprint_udf(chroma_fingerprint)


# --- long tables -----------------------------------------------------------


def frames_table(buffers: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, frame, samples: the overlapping frames of mono buffers at RATE."""
    n = F.size("samples")
    starts = F.when(n >= FRAME, F.sequence(F.lit(0), F.greatest(n, F.lit(FRAME)) - FRAME, F.lit(HOP)))
    return buffers.select(id_column, "samples", F.posexplode(starts).alias("frame", "at")).select(id_column, "frame", F.slice("samples", F.col("at") + 1, FRAME).alias("samples"))


def frames_of_samples(samples: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, frame, samples from a long table (id, pos, value). Samples are gathered once, by hop; hops then go to the frames that
    hold them (three whole ones and the start of a fourth), so no array ever holds a whole recording and a long one spreads
    over tasks. Incomplete frames are left out."""
    hops = samples.groupBy(id_column, F.floor(F.col("pos") / HOP).alias("hop")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    whole = FRAME // HOP
    spread = hops.select(id_column, "hop", F.col("x.value").alias("part"), F.explode(F.sequence(F.greatest(F.col("hop") - whole, F.lit(0)), F.col("hop"))).alias("frame"))
    part = F.when(F.col("hop") - F.col("frame") == whole, F.slice("part", 1, FRAME - whole * HOP)).otherwise(F.col("part"))
    grouped = spread.groupBy(id_column, "frame").agg(F.flatten(F.sort_array(F.collect_list(F.struct("hop", part.alias("part"))))["part"]).alias("samples"))
    return grouped.where(F.size("samples") == FRAME).select(id_column, F.col("frame").cast("int").alias("frame"), "samples")


def band_energy_table(frames: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, frame, band, energy."""
    edges = np.minimum(band_edges(), FRAME // 2)
    bands = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in zip(edges[:-1], edges[1:])])
    powered = frames.select(id_column, "frame", power_udf("hann")("samples").alias("power"))
    summed = F.transform(bands, lambda e: F.aggregate(F.slice(F.col("power"), e["a"] + 1, e["b"] - e["a"]), F.lit(0.0), lambda s, x: s + x))
    return powered.select(id_column, "frame", F.posexplode(summed).alias("band", "energy"))


def band_word_table(energies: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, pos, word: double differences over band and frame, as bits. Works frame by frame: windows hold one recording's frames."""
    rows = energies.groupBy(id_column, "frame").agg(F.sort_array(F.collect_list(F.struct("band", "energy"))).alias("x")).withColumn("e", F.col("x.energy"))
    rows = rows.withColumn("before", F.lag("e").over(Window.partitionBy(id_column).orderBy("frame"))).where("e[0] is not null and before[0] is not null")
    fall = lambda e, i: F.element_at(e, i + 1) - F.element_at(e, i + 2)
    powers = F.array(*[F.lit(1 << i).cast("long") for i in range(BANDS - 1)])
    bits = F.transform(powers, lambda p, i: F.when(fall(F.col("e"), i) - fall(F.col("before"), i) > 0, p).otherwise(F.lit(0).cast("long")))
    return rows.select(id_column, (F.col("frame") - 1).cast("int").alias("pos"), F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x).alias("word"))


def chroma_energy_table(frames: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, frame, note, energy."""
    bins = note_range()
    by_note = [[b for b in bins if note_of(b * RATE / FRAME) == n] for n in range(NOTES)]
    powered = frames.select(id_column, "frame", power_udf("hamming")("samples").alias("power"))
    runs = [[(g[0], len(g)) for g in _consecutive(own)] for own in by_note]
    add = lambda a, n: F.aggregate(F.slice("power", a + 1, n), F.lit(0.0), lambda s, x: s + x)
    sums = []
    for own in runs:
        total = F.lit(0.0)
        for a, n in own:
            total = total + add(a, n)
        sums.append(total)
    return powered.select(id_column, "frame", F.posexplode(F.array(*sums)).alias("note", "energy"))


def _consecutive(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][-1] == n - 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def smooth_table(energies: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, row, note, value: five-tap smoothing from the fifth frame on."""
    w = Window.partitionBy(id_column, "note").orderBy("frame")
    taps = sum((F.lag("energy", len(SMOOTH) - 1 - k).over(w) * c for k, c in enumerate(SMOOTH)), F.lit(0.0))
    return energies.select(id_column, (F.col("frame") - len(SMOOTH) + 1).cast("int").alias("row"), "note", taps.alias("value")).where("value is not null")


def normalise_table(smoothed: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """Rows to unit length; rows below the quiet gate become zero."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(id_column, "row")))
    return smoothed.withColumn("norm", norm).select(id_column, "row", "note", F.when(F.col("norm") < QUIET, 0.0).otherwise(F.col("value") / F.col("norm")).alias("value"))


def classifier_table(rows: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, pos, classifier, value, level: the sixteen rectangle classifiers over sixteen rows, as one window of rows each."""
    wide = rows.groupBy(id_column, "row").agg(F.sort_array(F.collect_list(F.struct("note", "value"))).alias("x")).withColumn("v", F.col("x.value"))
    w = Window.partitionBy(id_column).orderBy("row").rowsBetween(0, SPAN - 1)
    spans = wide.select(id_column, F.col("row").alias("pos"), F.collect_list("v").over(w).alias("m")).where(F.size("m") == SPAN)
    zero = F.lit(0.0)

    def area(r) -> Column:
        a, b, c, d = r
        if b <= a or d <= c:
            return zero
        return F.aggregate(F.slice("m", a + 1, b - a), zero, lambda s, row: s + F.aggregate(F.slice(row, c + 1, d - c), zero, lambda t, x: t + x))

    found = []
    for n, (kind, y, h, width, t0, t1, t2) in enumerate(CLASSIFIERS):
        plus, minus = (sum((area(r) for r in side), zero) for side in rectangles(kind, y, h, width))
        value = F.ln((1 + plus) / (1 + minus))
        found.append(F.struct(F.lit(n).alias("classifier"), value.alias("value"), F.lit(t0).alias("t0"), F.lit(t1).alias("t1"), F.lit(t2).alias("t2")))
    out = spans.select(id_column, "pos", F.explode(F.array(*found)).alias("c")).select(id_column, "pos", "c.*")
    level = F.when(F.col("value") < F.col("t1"), F.when(F.col("value") < F.col("t0"), 0).otherwise(1)).otherwise(F.when(F.col("value") < F.col("t2"), 2).otherwise(3))
    return out.select(id_column, "pos", "classifier", "value", level.alias("level"))


def chroma_word_table(levels: DataFrame, id_column: str = "recording_id") -> DataFrame:
    """id, pos, word: two Gray-coded bits per classifier, the first classifier on top."""
    gray = F.element_at(F.array(*map(F.lit, GRAY)), F.col("level") + 1).cast("long")
    shifted = F.expr("1L") * gray * F.pow(F.lit(4.0), F.lit(len(CLASSIFIERS) - 1) - F.col("classifier")).cast("long")
    return levels.groupBy(id_column, "pos").agg(F.sum(shifted).alias("word"))
