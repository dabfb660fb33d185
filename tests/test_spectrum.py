import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.functions import similarity as sim
from tonegrid.functions import spectrum as sp
from tonegrid.operators import audio
from tonegrid.sources import audio_source, pcm_files
from tonegrid.streaming import audio as stream


def tone(f, rate, n, gain=0.5):
    return (gain * np.sin(2 * np.pi * f * np.arange(n) / rate)).astype(np.float32)


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(0, 0.2, n).astype(np.float32)


def test_power_is_the_definition():
    x = noise(64)
    w = sp.hann(64)
    k = np.arange(32)[:, None]
    t = np.arange(64)[None]
    direct = np.abs((x * w * np.exp(-2j * np.pi * k * t / 64)).sum(1)) ** 2
    assert np.allclose(sp.power_spectra(x[None], w)[0], direct, atol=1e-9)


def test_word_counts():
    assert len(sp.band_words(noise(33075))) == 21 and len(sp.chroma_words(noise(33075))) == 3
    assert len(sp.band_words(noise(5460))) == 0 and len(sp.band_words(noise(5461))) == 1
    assert len(sp.chroma_words(noise(30030))) == 0 and len(sp.chroma_words(noise(30031))) == 1


def test_gain_leaves_band_words():
    x = noise(20000)
    assert sp.band_words(x).tolist() == sp.band_words(x * np.float32(0.25)).tolist()


def test_tables_equal_kernels(spark):
    x = noise(33075, 3)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording_id long, pos long, value float")
    frames = sp.frames_of_samples(rows)
    words = [r["word"] for r in sp.band_word_table(sp.band_energy_table(frames)).orderBy("pos").collect()]
    assert words == sp.band_words(x).tolist()
    unit = sp.normalise_table(sp.smooth_table(sp.chroma_energy_table(frames)))
    found = [r["word"] for r in sp.chroma_word_table(sp.classifier_table(unit)).orderBy("pos").collect()]
    assert found == sp.chroma_words(x).tolist()
    buffers = spark.createDataFrame([(1, x.tolist())], "recording_id long, samples array<float>")
    assert sp.frames_table(buffers).count() == frames.count()


def test_similarity_columns(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [1]), ([0xFFFFFFFF], [0])], "a array<long>, b array<long>")
    got = df.select(sim.similarity(F.col("a"), F.col("b")).alias("s"), sim.offset_similarity(F.col("a"), F.col("b"), 2).alias("o")).collect()
    assert got[0]["s"] == 1 - (2 + 1 + 3) / 96 and got[0]["o"] == 1.0
    assert got[1]["s"] == 0 and got[1]["o"] == 0 and got[2]["s"] == 0
    with pytest.raises(ValueError):
        sim.offset_similarity(F.col("a"), F.col("b"), -1)


def test_source_and_sink(spark, tmp_path):
    audio_source.register(spark)
    rows = [(f"{k}/{i}.{k}", k, noise(3000, i).tolist()) for i, k in enumerate(("wav", "flac", "alac", "aiff"))]
    df = spark.createDataFrame(rows, "path string, kind string, samples array<float>")
    for kind in ("wav", "flac", "alac", "aiff"):
        made = df.where(F.col("kind") == kind).select("path", audio.encoded(F.col("samples"), F.lit(8000), F.lit(2), kind).alias("content"))
        made.write.format("audio").mode("append").save(str(tmp_path))
    (tmp_path / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    probed = spark.read.format("audio").option("mode", "probe").option("bytes_per_task", 5000).load(str(tmp_path)).collect()
    assert sorted((r["container"], r["frames"]) for r in probed if r["error"] is None) == [("aiff", 1500), ("flac", 1500), ("mp4", 1500), ("wav", 1500)]
    assert [r["error"]["status"] for r in probed if r["error"]] == [3]
    decoded = spark.read.format("audio").option("mono", "true").option("sample_rate", 4000).load(str(tmp_path)).where("error is null").collect()
    assert {(r["sample_rate"], r["channels"], r["frames"], len(r["samples"])) for r in decoded} == {(4000, 1, 750, 750)}
    assert spark.read.format("audio").option("mode", "tags").load(str(tmp_path)).where("title = ''").count() == 5
    same = audio_source.read_binary(spark, str(tmp_path), "probe").where("error is null").groupBy("container").count().collect()
    assert len(same) == 4


def test_failfast_raises(spark):
    df = spark.createDataFrame([(bytearray(b"not audio"),)], "content binary")
    assert df.select(audio.decoded(F.col("content")).alias("b")).first()["b"]["error"]["status"] == 3
    with pytest.raises(Exception, match="unrecognised"):
        df.select(audio.decoded(F.col("content"), mode="failfast").alias("b")).collect()


def test_stream_equals_batch_whatever_the_blocks(spark, tmp_path):
    x = noise(12000, 9)
    cuts = [0, 10, 4096, 4100, 9000, 12000]
    rows = [(1, n, x[a:b].tolist()) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    order = [2, 0, 1, 4, 3, 0]  # late and repeated blocks
    for i, n in enumerate(order):
        spark.createDataFrame([rows[n]], "recording_id long, block_no long, samples array<float>").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("recording_id long, block_no long, samples array<float>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream.fingerprint_stream(source).writeStream.format("memory").queryName("words").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert [r["word"] for r in spark.table("words").orderBy("pos").collect()] == sp.band_words(x).tolist()
    w = stream.wave_blocks(source, f"{tmp_path}/blocks", f"{tmp_path}/state2").start()
    w.processAllAvailable()
    w.stop()
    made = stream.finish_waves(spark, f"{tmp_path}/blocks", 8000, 1).collect()
    assert bytes(made[0]["content"]) == pcm_files.write_wave(x, 8000, 1) and made[0]["frames"] == 12000


def test_fingerprints_of_lossless_files_agree(spark):
    x = noise(33075, 5)
    files = [bytearray(w(x, 11025, 1, 16)) for w in (pcm_files.write_wave, pcm_files.write_aiff)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content binary")
    got = audio.fingerprints(df).orderBy("i").collect()
    assert got[0]["fingerprint"]["words"] == got[1]["fingerprint"]["words"] and len(got[0]["chroma"]["words"]) == 3


def test_likely_pairs_are_all_that_share_a_key(spark):
    rng = np.random.default_rng(4)
    rows = [(i, p, int(w)) for i in range(60) for p, w in enumerate(rng.integers(0, 1 << 32, 3) * 16 % (1 << 32) + rng.integers(0, 3, 3))]
    rows += [(i, 9, 5) for i in range(40)] + [(100, 0, 7), (101, 0, 7), (102, 0, 8)]
    keys: dict = {}
    for i, _, w in rows:
        keys.setdefault(w & 15, set()).add(i)
    want = {(a, b) for ids in keys.values() for a in ids for b in ids if a < b}
    df = spark.createDataFrame(rows, "rec long, pos int, word long")
    for block in (1, 4, 256):
        found = sim.likely_pairs(df, "rec", 4, block).collect()
        assert len(found) == len(want) and {(r["a_id"], r["b_id"]) for r in found} == want
