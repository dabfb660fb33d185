"""Streams of sample blocks: incremental WAV files, and fingerprint words as they become known.

Blocks are rows recording_id, block_no, samples (mono, at the analysis rate for words; blocks of a recording in order)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import spectrum
from ..sources.pcm_files import WaveWriter

STATE = "kept binary, before binary, next_block long, words long, waiting binary"


def _step(samples: np.ndarray, before: np.ndarray | None) -> tuple[list[int], np.ndarray, np.ndarray | None]:
    """Words that samples complete, the samples still needed, and the last frame's band energies."""
    frames = spectrum.framed(samples)
    if not len(frames):
        return [], samples, before
    edges = np.minimum(spectrum.band_edges(), spectrum.FRAME // 2)
    power = spectrum.power_spectra(frames, spectrum.hann(spectrum.FRAME))
    energy = np.stack([power[:, a:b].sum(1) for a, b in zip(edges[:-1], edges[1:])], 1)
    rows = energy if before is None else np.vstack([before, energy])
    fall = rows[:, :-1] - rows[:, 1:]
    words = (((fall[1:] - fall[:-1]) > 0).astype(np.int64) << np.arange(spectrum.BANDS - 1)).sum(1)
    return words.tolist(), samples[len(frames) * spectrum.HOP :], energy[-1]


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import pickle

    kept, before, next_block, n, waiting = (np.zeros(0, np.float32), None, 0, 0, {})
    if state.exists:
        raw, old, next_block, n, late = state.get
        kept, before, waiting = np.frombuffer(raw, np.float32), np.frombuffer(old) if old else None, pickle.loads(late)
    for pdf in batches:
        for number, samples in zip(pdf["block_no"], pdf["samples"]):
            if number >= next_block:  # blocks that were taken before are repeats
                waiting[int(number)] = np.asarray(samples, np.float32)
    out = []
    while next_block in waiting:
        words, kept, before = _step(np.concatenate([kept, waiting.pop(next_block)]), before)
        out += [(key[0], n + i, w) for i, w in enumerate(words)]
        n, next_block = n + len(words), next_block + 1
    state.update((kept.tobytes(), before.tobytes() if before is not None else b"", next_block, n, pickle.dumps(waiting)))
    yield pd.DataFrame(out, columns=["recording_id", "pos", "word"])


def fingerprint_stream(blocks: DataFrame) -> DataFrame:
    """recording_id, pos, word, each as soon as its frame is complete. State per recording: less than a frame of samples, one row of
    energies, and blocks that came too early. Equal to the batch fingerprint whatever the block sizes; repeated blocks count once.
    Null samples count as 0."""
    samples = F.transform("samples", lambda x: F.coalesce(x, F.lit(0.0).cast("float"))).alias("samples")
    return blocks.select("recording_id", "block_no", samples).groupBy("recording_id").applyInPandasWithState(_update, "recording_id long, pos long, word long", STATE, "append", "NoTimeout")


def wave_blocks(blocks: DataFrame, path: str, checkpoint: str):
    """A stream of blocks into a table of blocks, each batch written once whatever is repeated; finish_waves() makes files of it."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return blocks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def finish_waves(spark, path: str, rate: int, channels: int, bits: int = 16) -> DataFrame:
    """recording_id, frames and content (a WAV) of all blocks written so far, in order of block_no, each block once."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        file = io.BytesIO()
        with WaveWriter(file, rate, channels, bits) as w:
            for samples in pdf.sort_values("block_no")["samples"]:
                w.write(np.asarray(samples, np.float32))
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "frames": [w.frames], "content": [file.getvalue()]})

    blocks = spark.read.schema("recording_id long, block_no long, samples array<float>").parquet(f"{path}/batch=*").dropDuplicates(["recording_id", "block_no"])
    return blocks.groupBy("recording_id").applyInPandas(join, "recording_id long, frames long, content binary")
