"""Vorbis: each transform against its definition, and a small stream written here bit by bit."""

import numpy as np
import pytest

from tonegrid.model import AudioError
from tonegrid.sources import ogg, probe, vorbis


class Low:
    """Writes bits from the lowest."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, count):
        self.value |= (value & ((1 << count) - 1)) << self.n
        self.n += count
        return self

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def test_imdct_is_the_definition():
    for half in (32, 128):
        x = np.random.default_rng(half).normal(size=half)
        n = 2 * half
        i, j = np.arange(n)[:, None], np.arange(half)[None]
        direct = (x * np.cos(np.pi / (2 * n) * (2 * i + 1 + half) * (2 * j + 1))).sum(1)
        assert np.allclose(vorbis.imdct(x), direct)


def test_windows_keep_power():
    for n in (64, 256):
        w = vorbis.window(n, n // 2, n // 2)
        assert np.allclose(w[: n // 2] ** 2 + w[n // 2 :] ** 2, 1)
    w = vorbis.window(256, 32, 128)
    assert not w[:48].any() and w[48] > 0 and w[80] == 1 and len(w) == 256


def test_code_words():
    assert vorbis.code_words([2, 4, 4, 4, 4, 2, 3, 3]) == [0, 4, 5, 6, 7, 2, 6, 7]
    for bad in ([1, 1, 1], [2, 2, 2]):
        with pytest.raises(AudioError):
            vorbis.code_words(bad)


def test_numbers():
    assert vorbis.bits_for(0) == 0 and vorbis.bits_for(1) == 1 and vorbis.bits_for(7) == 3
    assert vorbis.lattice_side(81, 4) == 3 and vorbis.lattice_side(80, 4) == 2
    assert vorbis.unpack_float(788 << 21 | 3) == 3.0 and vorbis.unpack_float(1 << 31 | 789 << 21 | 1) == -2.0
    assert vorbis.point(0, 10, 10, 0, 3) == 7 and vorbis.point(0, 0, 10, 5, 3) == 1


def test_lines_step_as_integers_do():
    out = np.zeros(12, np.int64)
    vorbis.line(0, 3, 10, 8, out)
    assert out.tolist() == [3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 0, 0]
    vorbis.line(10, 8, 20, 1, out)
    assert out[10:].tolist() == [8, 8]


def test_coupling_follows_the_table():
    m, a = np.array([2.0, 2, -2, -2, 0]), np.array([1.0, -1, 1, -1, 1])
    left, right = vorbis.uncouple(m, a)
    want = []
    for x, y in zip(m, a):
        if x > 0:
            want.append((x, x - y) if y > 0 else (x + y, x))
        else:
            want.append((x, x + y) if y > 0 else (x - y, x))
    assert list(zip(left, right)) == want


def headers(channels=1, rate=8000, small=6, large=6):
    first = b"\x01vorbis" + Low().put(0, 32).put(channels, 8).put(rate, 32).put(0, 96).put(small, 4).put(large, 4).put(1, 8).bytes()
    w = Low()
    w.put(0, 8)  # one codebook: two entries of one bit each, one dimension, values -1 and 1
    w.put(0x564342, 24).put(1, 16).put(2, 24).put(0, 1).put(0, 1).put(0, 5).put(0, 5)
    w.put(1, 4).put(1 << 31 | 788 << 21 | 1, 32).put(788 << 21 | 2, 32).put(0, 4).put(0, 1).put(0, 1).put(1, 1)
    w.put(0, 6).put(0, 16)  # time
    w.put(0, 6).put(1, 16).put(0, 5).put(0, 2).put(5, 4)  # one floor 1 without partitions, multiplier 1, range 2 ** 5
    w.put(0, 6).put(1, 16).put(0, 24).put(32, 24).put(31, 24).put(0, 6).put(0, 8).put(1, 3).put(0, 1).put(0, 8)  # one residue: one class, one pass
    w.put(0, 6).put(0, 16).put(0, 1).put(0, 1).put(0, 2).put(0, 8).put(0, 8).put(0, 8)  # mapping
    w.put(0, 6).put(0, 1).put(0, 16).put(0, 16).put(0, 8)  # mode
    w.put(1, 1)
    return [first, b"\x03vorbis" + bytes(8) + b"\x01", b"\x05vorbis" + w.bytes()]


def audio(signs=None):
    w = Low().put(0, 1)
    if signs is None:
        return w.put(0, 1).bytes()
    w.put(1, 1).put(255, 8).put(255, 8).put(0, 1)  # the floor at its top: amplitude 1
    for s in signs:
        w.put(int(s > 0), 1)
    return w.bytes()


def test_silent_stream():
    data = ogg.write_stream(headers() + [audio()] * 4)
    rate, channels, samples = vorbis.read_vorbis(data)
    assert (rate, channels, len(samples)) == (8000, 1, 96) and not samples.any()
    assert probe.probe(data) == {"container": "ogg", "codec": "vorbis", "sample_rate": 8000, "channels": 1, "frames": 0, "frames_known": False}


def test_stream_of_known_spectra():
    rng = np.random.default_rng(1)
    blocks = [rng.choice([-1, 1], 32) for _ in range(3)]
    _, _, got = vorbis.read_vorbis(ogg.write_stream(headers() + [audio(b) for b in blocks]))
    w = vorbis.window(64, 32, 32)
    pieces = [vorbis.imdct(b.astype(float)) * w for b in blocks]
    want = np.concatenate([a[32:] + b[:32] for a, b in zip(pieces, pieces[1:])])
    assert np.allclose(got, np.clip(want, -1, 1), atol=1e-6)


def test_other_codecs_are_named():
    for mark, name in ((b"OpusHead\x01", "opus"), (b"\x7fFLAC\x01", "flac")):
        with pytest.raises(AudioError, match=name):
            vorbis.read_vorbis(ogg.write_stream([mark, b"x"]))
    with pytest.raises(AudioError):
        vorbis.read_vorbis(ogg.write_stream(headers()[:2]))
