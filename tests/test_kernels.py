"""Byte formats: round trips, constructed inputs, hostile inputs."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonegrid.model import ArgumentError, AudioError
from tonegrid.sources import alac, flac, mp3, mp4, ogg, pcm_files, probe, tags
from tonegrid.sources.bits import BitReader, BitWriter, crc, rice_bits


def signals():
    rng = np.random.default_rng(1)
    return {
        "noise": rng.normal(0, 0.3, 9000), "harsh": rng.uniform(-1, 1, 5000), "sine": np.sin(np.arange(9002) * 0.01) * 0.9, "silence": np.zeros(1000), "sparse": (rng.random(6000) < 0.01) * 0.02,
        "one": np.array([0.25, -0.25]), "loud": np.full(5000, 3.0),
    }


@pytest.mark.parametrize("name", signals())
@pytest.mark.parametrize("channels", [1, 2])
def test_lossless_writers_give_quantised_samples_back(name, channels):
    samples = signals()[name].astype(np.float32)
    for write, depths in ((pcm_files.write_wave, (16, 24)), (flac.write_flac, (8, 16, 24)), (alac.write_alac, (16, 24)), (pcm_files.write_aiff, (8, 16, 24, 32))):
        for bits in depths:
            rate, found, back = probe.decode(write(samples, 22050, channels, bits))
            assert (rate, found) == (22050, channels)
            assert np.array_equal(back, pcm_files.from_codes(pcm_files.quantise(samples, bits), bits))


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 8191, 8192, 8193])
def test_frame_boundaries(n):
    samples = np.random.default_rng(n).normal(0, 0.1, n).astype(np.float32)
    for write in (flac.write_flac, alac.write_alac):
        assert len(probe.decode(write(samples, 8000, 1, 16))[2]) == n
        assert write(samples, 8000, 1, 16) == write(samples, 8000, 1, 16)


def test_silence_is_small():
    silent = np.zeros(1000, np.float32)
    assert len(flac.write_flac(silent, 8000, 1)) < 200
    assert len(alac.write_alac(silent, 8000, 1)) < 800


def test_probes_agree_with_decoding():
    samples = signals()["noise"].astype(np.float32)
    for write in (pcm_files.write_wave, pcm_files.write_aiff, flac.write_flac, alac.write_alac):
        data = write(samples, 44100, 2, 16)
        found = probe.exact(data)
        assert probe.probe(data[: probe.PREFIX], lambda d=data: d) == found and found["frames"] == 4500


def test_wave_probe_needs_a_prefix_only():
    data = pcm_files.write_wave(np.zeros(200_000, np.float32), 8000, 1)
    assert probe.probe(data[: probe.PREFIX])["frames"] == 200_000


def test_block_writer_equals_whole():
    samples = signals()["noise"].astype(np.float32)
    for cut in (1, 7, 450, 4500):
        file = io.BytesIO()
        with pcm_files.WaveWriter(file, 8000, 2) as w:
            for at in range(0, len(samples), 2 * cut):
                w.write(samples[at : at + 2 * cut])
            assert w.frames == 4500
        assert file.getvalue() == pcm_files.write_wave(samples, 8000, 2)
    with pytest.raises(ArgumentError):
        pcm_files.WaveWriter(io.BytesIO(), 8000, 2).write(np.zeros(3))
    empty = io.BytesIO()
    pcm_files.WaveWriter(empty, 8000, 1).close()
    assert len(pcm_files.read_wave(empty.getvalue())[2]) == 0


def test_arguments_are_checked_first():
    for write, bits in ((pcm_files.write_wave, 8), (flac.write_flac, 12), (alac.write_alac, 8)):
        with pytest.raises(ArgumentError):
            write(np.zeros(4), 8000, 1, bits)
    for rate, channels in ((0, 1), (768_001, 1), (8000, 0), (8000, 65)):
        with pytest.raises(ArgumentError):
            pcm_files.write_wave(np.zeros(0), rate, channels)
    with pytest.raises(ArgumentError):
        flac.write_flac(np.zeros(9), 8000, 9)
    with pytest.raises(ArgumentError):
        alac.write_alac(np.zeros(0), 8000, 1)


def test_quantiser():
    x = np.array([0.30001, 1.0, -1.0, 2.0, -2.0, 0.5 / 32768, -0.5 / 32768], np.float32)
    assert pcm_files.quantise(x, 16).tolist() == [9831, 32767, -32768, 32767, -32768, 1, -1]


def test_wave_refusals_and_tolerance():
    good = pcm_files.write_wave(np.zeros(4, np.float32), 8000, 1)
    odd = good[:12] + b"LIST\x03\0\0\0abc\0" + good[12:] + b"\0\0\0"
    assert len(pcm_files.read_wave(odd)[2]) == 4
    for bad in (good[:-1], good[:36], b"RIFX" + good[4:], good[:20] + b"\x07\0" + good[22:], good[:22] + b"\0\0" + good[24:], good + b"abc"):
        with pytest.raises(AudioError):
            pcm_files.read_wave(bad)


def test_float_and_extensible_waves():
    x = np.array([0.5, -2.0, 0.25], np.float32)
    for width, kind in ((4, "<f4"), (8, "<f8")):
        body = x.astype(kind).tobytes()
        fmt = (3).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + bytes(6) + (8 * width).to_bytes(2, "little")
        ext = b"\xfe\xff" + fmt[2:] + (22).to_bytes(2, "little") + bytes(6) + fmt[:2] + bytes(14)
        for f in (fmt, ext):
            data = b"RIFF\0\0\0\0WAVEfmt " + len(f).to_bytes(4, "little") + f + b"data" + len(body).to_bytes(4, "little") + body
            assert pcm_files.read_wave(data)[2].tolist() == x.tolist()


def test_aifc_kinds():
    plain = pcm_files.write_aiff(np.array([0.5, -0.5], np.float32), 44100, 1, 16)
    at = plain.index(b"COMM")
    for kind, ok in ((b"NONE", True), (b"twos", True), (b"ima4", False)):
        data = plain[:8] + b"AIFC" + b"COMM" + (24).to_bytes(4, "big") + plain[at + 8 : at + 26] + kind + b"\0\0" + plain[at + 26 :]
        if ok:
            assert pcm_files.read_aiff(data)[2].tolist() == [0.5, -0.5]
        else:
            with pytest.raises(AudioError, match="ima4"):
                pcm_files.read_aiff(data)
    little = plain[:8] + b"AIFC" + b"COMM" + (22).to_bytes(4, "big") + plain[at + 8 : at + 26] + b"sowt" + plain[at + 26 :]
    assert pcm_files.read_aiff(little)[2][0] == np.float32(0x40 / 32768)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(0, 40)), max_size=40))
def test_bits_round_trip(values):
    w = BitWriter()
    for v, n in values:
        w.put(v, n)
    assert w.length == sum(n for _, n in values)
    w.align()
    r = BitReader(w.to_bytes())
    assert [r.read(n) for _, n in values] == [v & ((1 << n) - 1) for v, n in values]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=60), st.integers(0, 9))
def test_rice_round_trip(codes, k):
    w = BitWriter()
    w.put(5, 3)
    w.put_bits(rice_bits(np.array(codes, np.int64), [len(codes)], [k], 0))
    w.align()
    r = BitReader(w.to_bytes())
    assert r.read(3) == 5 and r.rice(len(codes), k).tolist() == codes


def test_checks_of_known_values():
    assert crc(b"123456789", 8) == 0xF4 and crc(b"123456789", 16) == 0xFEE8 and crc(b"123456789", 32) == 0x89A1897F


def test_ogg_packets_over_pages():
    contents = [b"a" * 300, b"", b"b" * 255, b"c" * 10, bytes(range(256)) * 5]
    for per_page in (1, 2, 3, 255):
        found = ogg.packets(ogg.write_stream(contents, per_page=per_page))
        assert [p["data"] for p in found] == contents and found[-1]["ends"] and not found[0]["ends"]
    data = bytearray(ogg.write_stream(contents))
    data[40] ^= 1
    with pytest.raises(AudioError):
        ogg.packets(bytes(data))


def test_mp4_tables_and_offsets():
    frames = [bytes([i]) * (i + 1) for i in range(20)]
    data = mp4.write_track(b"alac", b"", 8000, 1, 16, frames, 64, 64 * 20, per_chunk=3)
    track = mp4.audio_track(data)
    assert [mp4.sample_data(data, s) for s in track["samples"]] == frames
    assert (track["codec"], track["rate"], track["duration"]) == ("alac", 8000, 1280)
    with pytest.raises(AudioError, match="mp4a"):
        alac.read_alac(mp4.write_track(b"mp4a", b"", 8000, 1, 16, frames, 64, 64 * 20))


def test_tags_of_all_schemes():
    v2 = tags.write_id3v2([("TIT2", "Été à Nice"), ("TRCK", "3/12"), ("TXXX", "Mood\0calm"), ("COMM", "hi")], 4, 1)
    found = tags.read_tags(v2 + tags.write_id3v1("x", "artist", "album", "1999", "c", 5, 17))
    assert (found["title"], found["artist"], found["comment"], found["trackNumber"], found["trackTotal"]) == ("Été à Nice", "artist", "hi", 3, 12)
    assert found["other"] == [("MOOD", "calm"), ("GENRECODE", "17")]
    for made in (tags.write_flac_tags([("title", "Été"), ("tracknumber", "3/12"), ("x", "1")]), ogg.write_stream([b"\x01vorbis", b"\x03vorbis" + tags.write_vorbis_comment([("Title", "Été"), ("TRACK", "3/12"), ("X", "1")])])):
        found = tags.read_tags(made)
        assert (found["title"], found["trackNumber"], found["trackTotal"], found["other"]) == ("Été", 3, 12, [("X", "1")])
    atoms = tags.write_mp4_tags([(b"\xa9nam", "Été".encode()), (b"disk", bytes([0, 0, 0, 1, 0, 2])), (b"covr", b"\xff\xd8"), (b"cprt", b"me")])
    found = tags.read_tags(atoms)
    assert (found["title"], found["discNumber"], found["discTotal"], found["other"]) == ("Été", 1, 2, [("cprt", "me")])
    assert tags.is_empty(tags.read_tags(b"RIFF\0\0\0\0WAVE")) and tags.is_empty(tags.empty() | {"trackTotal": 3})


@pytest.mark.parametrize("text,want", [("3/12", (3, 12)), ("7", (7, 0)), ("no 3/12/9", (3, 12)), ("5b/7", (5, 0)), ("", (0, 0)), ("/4", (0, 4)), ("3/b4", (3, 4))])
def test_split_count(text, want):
    assert tags.split_count(text) == want


def test_mpeg_frames():
    head = bytes([0xFF, 0xFB, 0x90, 0x64])
    frame = head + bytes(417 - 4)
    data = tags.write_id3v2([("TIT2", "x")]) + b"\xff\x00junk" + frame * 12 + tags.write_id3v1("a", "b", "c", "d", "e")
    found = mp3.frames(data)
    assert len(found) == 12 and found[0][1] == {"version": 3, "rate": 44100, "kbps": 128, "samples": 1152, "size": 417, "mode": 1, "channels": 2}
    assert probe.probe(data) == {"container": "mp3", "codec": "mp3", "sample_rate": 44100, "channels": 2, "frames": 0, "frames_known": False}


def test_hostile_bytes_never_crash():
    rng = random.Random(20260817)
    samples = signals()["sine"].astype(np.float32)[:600]
    files = [w(samples, 8000, 2, 16) for w in (pcm_files.write_wave, pcm_files.write_aiff, flac.write_flac, alac.write_alac)]
    files += [ogg.write_stream([b"\x01vorbis" + bytes(30), b"\x03vorbis" + tags.write_vorbis_comment([("a", "b")])]), tags.write_id3v2([("TIT2", "x")]), tags.write_mp4_tags([(b"\xa9nam", b"x")])]
    for data in files:
        for _ in range(60):
            bad = bytearray(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.4 else data)
            for _ in range(rng.randint(0, 6)):
                if bad:
                    bad[rng.randrange(len(bad))] = rng.randrange(256)
            for f in (probe.decode, probe.probe, tags.read_tags):
                try:
                    f(bytes(bad))
                except (AudioError, IndexError, ValueError, OverflowError, ArithmeticError):
                    pass  # the row's error, in Spark


@pytest.mark.parametrize("bits", [16, 24])
def test_alac_frames_side_by_side_are_those_one_by_one(monkeypatch, bits):
    from tonegrid.sources import alac_lanes

    rng = np.random.default_rng(bits)
    files = []
    for k in range(12):
        n, channels = int(rng.integers(1, 5000)), 1 + k % 2
        x = [np.sin(np.arange(n) * 0.05) * 0.5, rng.normal(0, 0.05, n), np.where(rng.random(n) < 0.01, rng.normal(0, 0.3, n), 0), np.zeros(n)][k % 4]
        files.append(alac.write_alac(np.stack([x] + [np.roll(x, 3) * 0.7] * (channels - 1), 1).reshape(-1).astype(np.float32), 8000, channels, bits))
    files += [files[0][:-40], b"no file", files[1][: len(files[1]) // 2] + rng.bytes(64) + files[1][len(files[1]) // 2 + 64 :]]

    def all_of(read):
        out = []
        for f in files:
            try:
                rate, channels, samples = read(f)
                out.append((rate, channels, samples.tobytes()))
            except (AudioError, ValueError, IndexError):
                out.append(None)
        return out

    monkeypatch.setattr(alac_lanes, "ENOUGH", 1 << 30)
    want = all_of(alac.read_alac)
    monkeypatch.setattr(alac_lanes, "ENOUGH", 1)
    assert all_of(alac.read_alac) == want
    assert [None if isinstance(f, AudioError) else (f[0], f[1], f[2].tobytes()) for f in alac.read_many(files)] == want
    assert sum(w is None for w in want) >= 2
