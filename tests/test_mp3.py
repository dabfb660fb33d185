"""Layer 3: streams written here bit by bit, with made-up code tables, against a plain decoder that follows the standard's steps one by one."""

import math

import numpy as np
import pytest

from tonegrid.model import AudioError
from tonegrid.sources import layer3, mp3, probe

MOST = {1: 1, 2: 2, 3: 2, 5: 3, 6: 3, 7: 5, 8: 5, 9: 5, 10: 7, 11: 7, 12: 7, 13: 15, 15: 15, 16: 15, 24: 15}


def made_words(symbols, rng, prefix=""):
    if len(symbols) == 1:
        return {symbols[0]: prefix}
    k = int(rng.integers(max(1, len(symbols) // 4), max(2, 3 * len(symbols) // 4 + 1)))
    k = min(k, len(symbols) - 1)
    return made_words(symbols[:k], rng, prefix + "0") | made_words(symbols[k:], rng, prefix + "1")


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    return {t: made_words([tuple(x) for x in rng.permutation([(a, b) for a in range(m + 1) for b in range(m + 1)]).tolist()], rng) for t, m in MOST.items()}


@pytest.fixture(scope="module")
def window():
    return np.random.default_rng(4).normal(0, 0.1, 512).round(9)


@pytest.fixture(scope="module")
def tables(words, window, tmp_path_factory):
    path = tmp_path_factory.mktemp("mp3") / "tables.txt"
    path.write_text("".join(f"code {t} {x} {y} {w}\n" for t, own in words.items() for (x, y), w in own.items()) + "".join(f"window {i} {v}\n" for i, v in enumerate(window)))
    return layer3.load_tables(str(path))


def part_bits(s, lines, factors, widths, slens, words):
    """A granule's main data: scalefactors, pairs by one table for each region, quadruples."""
    out = "".join(format(int(f), f"0{w}b") for f, w in zip(factors, slens) if w)
    big = 2 * s["big"]
    edges = np.cumsum(widths)
    if s["kind"] == 0:
        borders = [edges[s["r0"]], edges[min(s["r0"] + s["r1"] + 1, len(edges) - 1)], 576]
    else:
        borders = [edges[8 if s["kind"] == 2 and not s["mixed"] else 7], 576, 576]
    for at in range(0, big, 2):
        table = s["tables"][next(i for i, b in enumerate(borders) if at < b)]
        pair, tail = [], ""
        extra = layer3.LINBITS[table - 16] if table >= 16 else 0
        for v in lines[at : at + 2]:
            a = abs(int(v))
            pair.append(min(a, 15) if extra else a)
            tail += (format(a - 15, f"0{extra}b") if extra and a >= 15 else "") + (str(int(v < 0)) if v else "")
        out += (words[table if table < 16 else 16 if table < 24 else 24][tuple(pair)] if table else "") + tail
    last = max(np.flatnonzero(lines), default=-1)
    for at in range(big, last + 1, 4):
        four = lines[at : at + 4]
        number = int("".join(str(abs(int(v))) for v in four), 2)
        out += (format(15 - number, "04b") if s["quad"] else layer3.QUADS[number]) + "".join(str(int(v < 0)) for v in four if v)
    return out


def slens(s, first, widths):
    if first:
        a, b = layer3.WIDTHS[s["compress"]]
        if s["kind"] != 2:
            return [a] * 11 + [b] * 10
        return [a] * (17 if s["mixed"] else 18) + [b] * 18
    x = s["compress"]
    row, four = (0, ((x >> 4) // 5, (x >> 4) % 5, (x % 16) >> 2, x % 4)) if x < 400 else (1, (((x - 400) >> 2) // 5, ((x - 400) >> 2) % 5, (x - 400) % 4, 0)) if x < 500 else (2, ((x - 500) // 3, (x - 500) % 3, 0, 0))
    kind = 0 if s["kind"] != 2 else 2 if s["mixed"] else 1
    return [w for n, w in zip(layer3.COUNTS[kind][row], four) for _ in range(n)]


def bands(rate, s, first):
    return layer3.layout(rate, s, first)


RATE_BITS = {44100: (3, 0), 48000: (3, 1), 32000: (3, 2), 22050: (2, 0), 24000: (2, 1), 16000: (2, 2), 8000: (0, 2)}


def write(granules, rate, channels, words, extension=0, checked=False, tag=b""):
    """granules: for each a list of (s, lines, factors) by channel."""
    version, rate_index = RATE_BITS[rate]
    first = version == 3
    per, side = (2, 17 if channels == 1 else 32) if first else (1, 9 if channels == 1 else 17)
    mode = 3 if channels == 1 else 1 if extension else 0
    head = bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | (0 if checked else 1), 14 << 4 | rate_index << 2, mode << 6 | extension << 4])
    size = mp3.header(head, 0)["size"]
    room = size - 4 - side - 2 * checked
    frames, payload, end = [], b"", 0
    groups = [granules[i : i + per] for i in range(0, len(granules), per)]
    for number, group in enumerate(groups):
        start = max(end, number * room - (500 if first else 250))
        begin, texts, fields = number * room - start, [], ""
        for row in group:
            for s, lines, factors in row:
                widths, _ = bands(rate, s, first)
                texts.append(part_bits(s, lines, factors, widths, slens(s, first, widths), words))
        fields = format(begin, "09b" if first else "08b") + "0" * {(True, 1): 5, (True, 2): 3, (False, 1): 1, (False, 2): 2}[first, channels]
        fields += ("0000" * channels) if first else ""
        for (s, _, _), text in zip([x for row in group for x in row], texts):
            fields += format(len(text), "012b") + format(s["big"], "09b") + format(s["gain"], "08b") + format(s["compress"], "04b" if first else "09b")
            if s["kind"]:
                fields += "1" + format(s["kind"], "02b") + str(s["mixed"]) + "".join(format(t, "05b") for t in s["tables"][:2]) + "".join(format(g, "03b") for g in s["sub"])
            else:
                fields += "0" + "".join(format(t, "05b") for t in s["tables"]) + format(s["r0"], "04b") + format(s["r1"], "03b")
            fields += (str(s["pre"]) if first else "") + str(s["scale"]) + str(s["quad"])
        assert len(fields) <= 8 * side
        bits = "".join(texts)
        raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        payload = payload.ljust(start, b"\0") + raw
        end = start + len(raw)
        assert end <= (number + 1) * room
        frames.append(head + b"\x12\x34" * checked + int(fields.ljust(8 * side, "0"), 2).to_bytes(side, "big"))
    payload = payload.ljust(len(groups) * room, b"\0")
    if tag:
        payload = tag.ljust(room, b"\0") + payload[room:]
    return b"".join(f + payload[i * room : (i + 1) * room] for i, f in enumerate(frames))


def plain(granules, rate, channels, window, extension=0):
    """The standard's decoding, step by step; samples (n, channels)."""
    first = RATE_BITS[rate][0] == 3
    overlap, fifo, out = np.zeros((channels, 32, 18)), np.zeros((channels, 1024)), []
    for row in granules:
        spectra = []
        for s, lines, factors in row:
            widths, long = bands(rate, s, first)
            xr, at = np.zeros(576), 0
            for b, w in enumerate(widths):
                f = int(factors[b]) if b < len(factors) else 0
                if s["pre"] and s["kind"] != 2 and 11 <= b < 21:
                    f += layer3.PRETAB[b - 11]
                gain = s["gain"] - 210 - (8 * s["sub"][(b - long) % 3] if s["kind"] == 2 and b >= long else 0)
                for i in range(at, at + w):
                    xr[i] = math.copysign(abs(int(lines[i])) ** (4 / 3), lines[i]) * 2 ** (gain / 4) * 2 ** (-(1 if s["scale"] else 0.5) * f)
                at += w
            spectra.append(xr)
        if extension & 2:
            m, d = spectra
            spectra = [(m + d) / math.sqrt(2), (m - d) / math.sqrt(2)]
        pcm = np.zeros((18, 32, channels))
        for c, ((s, _, _), xr) in enumerate(zip(row, spectra)):
            widths, long = bands(rate, s, first)
            edge = 576
            if s["kind"] == 2:
                edge, at, again = int(sum(widths[:long])), int(sum(widths[:long])), xr.copy()
                for w in widths[long::3]:
                    for k in range(3):
                        for i in range(w):
                            again[at + 3 * i + k] = xr[at + k * w + i]
                    at += 3 * w
                xr = again
            for sb in range(1, 32):
                if 18 * sb < edge:
                    for i in range(8):
                        ca = layer3.BUTTERFLY[i] / math.sqrt(1 + layer3.BUTTERFLY[i] ** 2)
                        cs = 1 / math.sqrt(1 + layer3.BUTTERFLY[i] ** 2)
                        u, d = xr[18 * sb - 1 - i], xr[18 * sb + i]
                        xr[18 * sb - 1 - i], xr[18 * sb + i] = u * cs - d * ca, d * cs + u * ca
            for sb in range(32):
                x, y = xr[18 * sb : 18 * sb + 18], np.zeros(36)
                kind = s["kind"] if s["kind"] != 2 or 18 * sb >= edge else 0
                if kind == 2:
                    for k in range(3):
                        for i in range(12):
                            y[6 + 6 * k + i] += math.sin(math.pi / 12 * (i + 0.5)) * sum(x[3 * j + k] * math.cos(math.pi / 24 * (2 * i + 7) * (2 * j + 1)) for j in range(6))
                else:
                    for i in range(36):
                        shape = math.sin(math.pi / 36 * (i + 0.5))
                        if kind == 1 and i >= 18:
                            shape = 1 if i < 24 else math.sin(math.pi / 12 * (i - 18 + 0.5)) if i < 30 else 0
                        if kind == 3 and i < 18:
                            shape = 0 if i < 6 else math.sin(math.pi / 12 * (i - 6 + 0.5)) if i < 12 else 1
                        y[i] = shape * sum(x[j] * math.cos(math.pi / 72 * (2 * i + 19) * (2 * j + 1)) for j in range(18))
                now = y[:18] + overlap[c, sb]
                overlap[c, sb] = y[18:]
                pcm[:, sb, c] = [-v if sb % 2 and t % 2 else v for t, v in enumerate(now)]
            for t in range(18):
                fifo[c] = np.concatenate([[sum(math.cos(math.pi / 64 * (16 + i) * (2 * k + 1)) * pcm[t, k, c] for k in range(32)) for i in range(64)], fifo[c][:960]])
                u = np.concatenate([np.concatenate([fifo[c][128 * i : 128 * i + 32], fifo[c][128 * i + 96 : 128 * i + 128]]) for i in range(8)])
                pcm[t, :, c] = (u * window).reshape(16, 32).sum(0)
        out.append(pcm.reshape(576, channels))
    return np.concatenate(out)


def granule(rng, rate, first, kind=0, mixed=0, table=7, quads=0, **more):
    s = {"kind": kind, "mixed": mixed, "big": 60, "gain": 190, "compress": 9 if first else 150, "tables": [table] * 3, "sub": (0, 1, 2) if kind else (0, 0, 0), "r0": 3, "r1": 4, "pre": 0, "scale": 0, "quad": 0} | more
    widths, _ = bands(rate, s, first)
    lines = np.zeros(576, np.int64)
    most = MOST.get(table if table < 16 else 16 if table < 24 else 24, 0) + (min(6, (1 << layer3.LINBITS[table - 16]) - 1) if table >= 16 else 0)
    lines[: 2 * s["big"]] = rng.integers(-most, most + 1, 2 * s["big"]) if table else 0
    lines[2 * s["big"] : 2 * s["big"] + 4 * quads] = rng.integers(-1, 2, 4 * quads)
    factors = [int(rng.integers(0, 1 << w)) if w else 0 for w in slens(s, first, widths)]
    return s, lines, factors


def test_long_and_short_blocks_of_both_versions(words, tables, window):
    rng = np.random.default_rng(1)
    for rate, kinds in ((44100, [(0, 0), (1, 0), (2, 0), (3, 0), (1, 0), (2, 1), (3, 0), (0, 0)]), (22050, [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)]), (8000, [(2, 1), (2, 0), (0, 0)])):
        first = RATE_BITS[rate][0] == 3
        rows = [[granule(rng, rate, first, k, m, table=t, quads=5, scale=i % 2, quad=i // 2 % 2, pre=int(first and not k))] for i, ((k, m), t) in enumerate(zip(kinds, (7, 1, 13, 15, 17, 24, 9, 2)))]
        if not first:
            for (s, _, _), *_ in rows:
                s["pre"] = 0
        data = write(rows, rate, 1, words, checked=rate == 22050)
        got = mp3.read_mp3(data, tables)
        assert got[:2] == (rate, 1)
        assert np.allclose(got[2], plain(rows, rate, 1, window)[:, 0], atol=1e-5)


def test_middle_and_side(words, tables, window):
    rng = np.random.default_rng(2)
    rows = [[granule(rng, 32000, True, quads=3), granule(rng, 32000, True, table=3)] for _ in range(4)]
    data = write(rows, 32000, 2, words, extension=2)
    rate, channels, samples = mp3.read_mp3(data, tables)
    assert (rate, channels) == (32000, 2)
    assert np.allclose(samples.reshape(-1, 2), plain(rows, 32000, 2, window, 2), atol=1e-5)


def test_intensity_deals_one_channel_by_position(words, tables):
    rng = np.random.default_rng(5)
    for place, share in ((0, (0.0, 1.0)), (2, (0.36602540378, 0.63397459621)), (3, (0.5, 0.5)), (6, (1.0, 0.0))):
        left = granule(rng, 44100, True, table=5)
        right = granule(rng, 44100, True, table=0, big=0, compress=15)
        right = (right[0], right[1], [place] * 21)  # four bits for the low bands, three for the high ones
        rows = [[left, right], [left, right]]
        both = mp3.read_mp3(write(rows, 44100, 2, words, extension=1), tables)[2].reshape(-1, 2)
        alone = mp3.read_mp3(write([[left], [left]], 44100, 1, words), tables)[2]
        assert np.allclose(both, alone[:, None] * share, atol=1e-5)


def test_unusual_positions_leave_bands_alone(words, tables):
    rng = np.random.default_rng(6)
    left, right = granule(rng, 44100, True, table=5), granule(rng, 44100, True, table=0, big=0, compress=15)
    rows = [[left, (right[0], right[1], [7] * 21)]] * 2
    both = mp3.read_mp3(write(rows, 44100, 2, words, extension=1), tables)[2].reshape(-1, 2)
    assert both[:, 0].any() and not both[:, 1].any()


def silence(n, rate=44100, channels=1, tag=b""):
    s = {"kind": 0, "mixed": 0, "big": 0, "gain": 0, "compress": 0, "tables": [0] * 3, "sub": (0, 0, 0), "r0": 0, "r1": 0, "pre": 0, "scale": 0, "quad": 0}
    return write([[(s, np.zeros(576, np.int64), [])] * channels] * n, rate, channels, {}, tag=tag)


def test_silence_needs_no_tables_and_tags_trim():
    assert mp3.read_mp3(silence(6))[2].tolist() == [0.0] * 6 * 576
    assert len(mp3.read_mp3(b"ID3\4\0\0\0\0\0\5extra" + silence(4, 22050, 2) + b"TAG" + bytes(125))[2]) == 4 * 576 * 2
    told = b"Info" + (15).to_bytes(4, "big") + bytes(4 + 4 + 100 + 4) + b"LAME3.100" + bytes(12) + (600 << 12 | 700).to_bytes(3, "big")
    data = silence(8, tag=told)
    assert len(mp3.read_mp3(data)[2]) == 6 * 576 - (600 + 529) - (700 - 529)
    assert mp3.gapless(data, 0, 1044) == (600, 700) and mp3.gapless(silence(2), 0, 1044) is None
    assert len(mp3.read_mp3(silence(8, tag=told.replace((600 << 12 | 700).to_bytes(3, "big"), (4095 << 12 | 700).to_bytes(3, "big"))))[2]) == 0
    assert probe.probe(silence(2, 48000, 2)) == {"container": "mp3", "codec": "mp3", "sample_rate": 48000, "channels": 2, "frames": 0, "frames_known": False}
    assert probe.exact(silence(6))["frames"] == 6 * 576


def test_refusals(words, tables):
    with pytest.raises(AudioError, match="no frame header"):
        mp3.read_mp3(b"RIFF____WAVEfmt " + bytes(200))
    with pytest.raises(AudioError, match="layer 2"):
        mp3.read_mp3(bytes([0xFF, 0xFD, 0x90, 0x00]) + bytes(500))
    rng = np.random.default_rng(7)
    rows = [[granule(rng, 44100, True)] for _ in range(2)]
    with pytest.raises(AudioError, match="mp3_tables"):
        mp3.read_mp3(write(rows, 44100, 1, words))


def test_hostile_streams_end_in_errors_or_samples(words, tables):
    rng = np.random.default_rng(8)
    data = write([[granule(rng, 44100, True, quads=4)] for _ in range(6)], 44100, 1, words)
    for n in [*range(0, 300, 7), *range(300, len(data), 191)]:
        try:
            mp3.read_mp3(data[:n], tables)
        except AudioError:
            pass
    for _ in range(60):
        raw = bytearray(data)
        for at in rng.integers(0, len(raw), 12):
            raw[at] ^= int(rng.integers(1, 256))
        try:
            assert np.isfinite(mp3.read_mp3(bytes(raw), tables)[2]).all()
        except AudioError:
            pass


def test_frames_after_a_broken_one_begin_anew(words, tables):
    rng = np.random.default_rng(9)
    rows = [[granule(rng, 44100, True)] for _ in range(8)]
    data, tail = write(rows[:4], 44100, 1, words), write(rows[4:], 44100, 1, words)
    size = mp3.header(data, 0)["size"]
    broken = bytearray(data)
    broken[size + 4 + 2 : size + 4 + 5] = b"\xff\xff\xff"  # lengths beyond what there is
    # The second frame is lost, and with it the bits behind it; the next stream borrows nothing at first.
    got = mp3.read_mp3(bytes(broken) + tail, tables)[2]
    assert np.allclose(got, np.concatenate([mp3.read_mp3(data, tables)[2][:1152], mp3.read_mp3(tail, tables)[2]]))
