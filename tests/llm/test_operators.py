import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tonegrid.llm import bpe, lines, media, minhash, packing, pfp, secrets, tokenstore, topk, toxicity

from . import cases

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, [])


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe_is_that_of_the_library(spark, docs, empty):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})

    def one(_, t):
        i = e.encode_ordinary(t or "")
        return len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for size in (200, 1 << 20):
        assert cases.by_id(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, size)) == cases.expected(one)
    whole = bpe.encode_ids(docs, RANKS, public_tokenizers.PATTERN)
    assert cases.by_id(whole) == cases.expected(lambda _, t: (e.encode_ordinary(t or ""), (t or "").encode()))
    again = bpe.decode(whole, RANKS)
    assert cases.by_id(again) == cases.expected(lambda _, t: ((t or "").encode(),))
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def brute_top(rows, k=10):
    out = []
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in good:
        if i % 100 == 0:
            asks.setdefault((i, len(v)), []).append(v.tolist())
    for (i, n), vs in asks.items():
        q = np.array(min(vs))
        scored = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == n)
        out += [(i, s, j) for s, j in scored[:k]]
    return sorted(out)


@pytest.mark.parametrize("block", [70, 16384])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.15, 16).astype(np.float32).tolist()) for i in range(0, 600)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)] + [(2000, [0.0] * 16), (2001, [0.0] * 16), (2100, [-0.3] * 16)]
    rows += [(None, [0.1] * 16), (3000, None), (3100, []), (3200, [None] + [0.1] * 15), (3300, [float("nan")] * 16), (3400, [float("inf")] + [0.0] * 15), (3500, [0.5, 0.5]), (3501, [0.25, 0.5]), rows[3], rows[100]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, block string")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, rows=block, pack=3)
    got = sorted((r["query_id"], -r["score"], r["vec_id"]) for r in found.collect())
    assert got == brute_top(rows)
    ranks = {}
    for r in found.collect():
        ranks.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for v in ranks.values():
        assert sorted(v) == sorted(v, key=lambda x: x[1:]) and [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_top_k_refuses_what_may_overflow(spark):
    df = spark.createDataFrame([(0, [0.5, 20000.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="quantised component"):
        topk.top_k(df, F.col("vec_id") % 100 == 0).collect()


def test_bit_sliced_sums():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, (9, 130))
    levels: dict = {}
    for v in values:
        for b in range(6):
            bits = np.zeros(24, np.uint8)
            packed = np.packbits((v >> b & 1).astype(bool), bitorder="little")
            bits[: len(packed)] = packed
            levels.setdefault(b, []).append(bits.view(np.uint64))
    sums = topk.add_slices([np.stack(levels[b]) for b in range(6)])
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << w) for w, s in enumerate(sums) if s is not None)
    assert (total == values.sum(0)).all()
    rows = np.packbits(np.r_[np.ones(130, bool), np.zeros(62, bool)], bitorder="little").view(np.uint64)
    assert topk.kth_largest(sums, rows, 7) == sorted(values.sum(0))[-7]


def brute_repeats(rows, length=50):
    raw, first, out = [(d, (t or "").encode()) for d, t in rows], {}, []
    for d, b in raw:
        if d is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, d), d)
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        if d is not None:
            for s in range(len(b) - length + 1):
                if first[b[s : s + length]] < d:
                    gone[s : s + length] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return out


@pytest.mark.parametrize("block", [300, 5000, 1 << 20])
def test_repeats_are_those_of_all_strings(spark, docs, empty, block):
    want: dict = {}
    for d, x in brute_repeats(cases.texts()):
        want.setdefault(d, []).append(x)
    assert cases.by_id(pfp.remove_repeats(docs, block_bytes=block)) == {k: sorted(v, key=str) for k, v in want.items()}
    if block == 300:
        assert pfp.remove_repeats(empty).collect() == []


def test_repeats_in_periodic_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pfp, "STRETCH", 64)
    rng = random.Random(8)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(7, base), (3, base[100:300] + "c" + base[:90]), (9, "a" * 200), (8, "a" * 60), (1, "ab" * 60), (2, "ba" * 60), (20, base[50:99]), (21, base[50:100]), (5, base[40:95] * 2)]
    want = {d: [x] for d, x in brute_repeats(rows)}
    assert cases.by_id(pfp.remove_repeats(cases.documents(spark, rows), block_bytes=500)) == want


def test_repeats_behind_a_trigger_that_all_documents_share(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz "
    common = "".join(rng.choice(letters) for _ in range(40))
    sides = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(letters) for _ in range(60)) + rng.choice(sides) + common + rng.choice(sides) + str(i)) for i in range(120)]
    want = {d: [x] for d, x in brute_repeats(rows)}
    assert cases.by_id(pfp.remove_repeats(cases.documents(spark, rows), block_bytes=2000)) == want
    assert sum(x[0][1] > 0 for x in want.values()) > 100


def test_repeats_in_a_text_beyond_eight_million_bytes(spark):
    rng = np.random.default_rng(5)
    long = rng.integers(97, 123, (1 << 23) + 5000).astype(np.uint8).tobytes().decode()
    edge = 1 << 22  # the text is parsed in overlapping parts of this size
    rows = [(1, long), (2, "A" * 30 + long[edge - 400 : edge + 600] + "B" * 30 + long[-70:]), (0, "C" * 20 + long[2 * edge - 25 : 2 * edge + 25])]
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in pfp.remove_repeats(cases.documents(spark, rows)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[0] == (0, 0, digest(rows[2][1]))
    assert found[1] == (50, 1, digest(long[: 2 * edge - 25] + long[2 * edge + 25 :]))
    assert found[2] == (1070, 2, digest("A" * 30 + "B" * 30))


def test_phrases_cover_each_string_once():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    ends = np.array([0, 30, 30, 700, 749, 2000, 3000])
    starts, counts, _ = pfp.parse(raw, ends, 50)
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)])
    assert covered.tolist() == [s for a, b in zip(ends[:-1], ends[1:]) for s in range(a, b - 49)]


def test_media_round_trip(spark, docs, empty, tmp_path):
    found = media.store_and_describe(docs, range_bytes=3000, batch_bytes=500)

    def one(_, t):
        b = (t or "").encode()
        p = media.pad(b)
        m = media.encode_png(p)
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(np.frombuffer(p, np.uint8))

    assert cases.by_id(found) == cases.expected(one)
    assert media.store_and_describe(empty).collect() == []


def test_media_members_are_tried_again_by_offset(spark, tmp_path):
    media.write_archives(cases.documents(spark, [(1, "abc"), (2, "def")]).coalesce(1), str(tmp_path))
    reader = media.ArchiveReader(str(tmp_path), 1 << 20, 3, 1 << 20)
    part = reader.partitions()[0]
    path = next(tmp_path.glob("*.arc"))
    good = path.read_bytes()
    calls, plain = [], media.ArchiveReader._read

    def flaky(f, offset):
        calls.append(offset)
        if calls.count(offset) < 3 and offset:
            raise OSError("lost")
        return plain(f, offset)

    reader._read = flaky
    assert sorted(x for b in reader.read(part) for x in b["doc_id"].to_pylist()) == [1, 2]
    assert calls.count(0) == 1 and len(calls) == 4
    reader._read = plain
    path.write_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    with pytest.raises(ValueError):
        list(reader.read(part))
    for cut in (media.HEAD.size - 1, len(good) - 1):  # a member cut short is tried as often as any other
        path.write_bytes(good[:cut])
        calls.clear()
        reader._read = lambda f, offset: calls.append(offset) or plain(f, offset)
        with pytest.raises(ValueError):
            list(reader.read(part))
        assert calls.count(calls[-1]) == 1 + reader.tries


def test_media_by_an_independent_reading(spark):
    """What is stored, taken apart by the format's definition alone."""
    import struct

    rows = [(1, "some text"), (2, ""), (3, None), (4, "é" * 100_000)]
    found = {r["doc_id"]: r.asDict() for r in media.store_and_describe(cases.documents(spark, rows)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw.ljust(size, b"\0")
        png = media.encode_png(payload)
        assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10]) and struct.unpack(">IIBBBBB", png[16:29]) == (64, size // 64, 8, 0, 0, 0, 0)
        (length,) = struct.unpack(">I", png[33:37])
        lines_ = zlib.decompress(png[41 : 41 + length])
        assert b"".join(lines_[65 * i + 1 : 65 * i + 65] for i in range(size // 64)) == payload and set(lines_[::65]) == {0}
        r = found[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_those_of_all_pairs(spark, docs, empty, words):
    rows = cases.texts()
    want = cases.components(rows, words)
    sizes = cases.word_sets(rows, words)
    expected: dict = {}
    for (d, _), s in zip(rows, sizes):
        expected.setdefault(d, []).append((len(s), want[d], d is not None and want[d] == d))
    assert cases.by_id(minhash.classes(docs, words=words)) == {k: sorted(v, key=str) for k, v in expected.items()}
    if words == 2:
        assert minhash.classes(empty, words=2).collect() == []


def test_near_copies_in_chains_and_crowds(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows, text = [], list(base)
    for i in range(30):  # a chain: each a little further from the first
        rows.append((500 - i, " ".join(text)))
        text[rng.randrange(len(text))] = "new%d" % i
    for i in range(300):  # a crowd around one text
        own = list(base)
        own[rng.randrange(len(own))] = "c%d" % i
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(50)]
    want = cases.components(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(cases.documents(spark, rows), words=2).collect()}
    assert got == {d: want[d] for d, _ in rows}
    kept = {r["doc_id"] for r in minhash.deduplicate(cases.documents(spark, rows), words=2).collect()}
    assert kept == set(want.values()) - {None}


def brute_lines(rows, m=2):
    """Texts with later copies of runs of m lines cut out; rows of one id with equal texts share one place."""
    first: dict = {}
    places = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0])
    split = {p: p[1].split("\n") for p in places}
    for p in places:
        for i in range(len(split[p]) - m + 1):
            run = tuple(split[p][i : i + m])
            first.setdefault(run, (p, i))
    out = []
    for d, t in rows:
        if d is None or t is None:
            out.append((d, t, 0))
            continue
        ls, gone = split[d, t], set()
        for i in range(len(ls) - m + 1):
            run = tuple(ls[i : i + m])
            if any(x.strip(" \t\r") for x in run) and first[run] != ((d, t), i):
                gone |= set(range(i, i + m))
        out.append((d, "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone)))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_line_runs(spark, m):
    rng = random.Random(m)
    pool = ["line %d" % i for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), rows[4], rows[4]]
    found = lines.remove_lines(cases.documents(spark, rows), min_lines=m, counts=True)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["n_removed"]) for r in found.collect())
    assert got == sorted((-1 if d is None else d, t or "", n) for d, t, n in brute_lines(rows, m))
    assert found.columns[: len(cases.SCHEMA.split(","))] == [c.split()[0] for c in cases.SCHEMA.split(", ")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_long_single_lines(spark, seed):
    rng = random.Random(seed)
    long = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((50, 50, 60, 49))]
    pool = [*long, "short one", "", "  "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (None, rows[0][1]), rows[4], rows[4], (101, long[2])]
    places = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0])
    first: dict = {}
    for p in places:
        for i, x in enumerate(p[1].split("\n")):
            first.setdefault(x, (p, i))
    pairs: dict = {}
    for p in places:
        ls = p[1].split("\n")
        for i in range(len(ls) - 1):
            pairs.setdefault((ls[i], ls[i + 1]), (p, i))
    want = []
    for d, t in rows:
        if d is None or t is None:
            want.append((-1 if d is None else d, t or "", 0))
            continue
        ls = t.split("\n")
        gone = {i for i, x in enumerate(ls) if len(x.split()) >= 50 and first[x] != ((d, t), i)}
        for i in range(len(ls) - 1):
            if (ls[i] + ls[i + 1]).strip() and pairs[ls[i], ls[i + 1]] != ((d, t), i):
                gone |= {i, i + 1}
        want.append((d, "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone)))
    found = lines.remove_lines(cases.documents(spark, rows), counts=True, long_words=50).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["n_removed"]) for r in found) == sorted(want)


def test_lines_of_the_cases_and_of_nothing(spark, docs, empty):
    rows = [r for r in cases.texts() if r != (5, "another text of the same id")]
    got = sorted(((r["doc_id"] or -1), r["text"] or "") for r in lines.remove_lines(cases.documents(spark, rows)).collect())
    assert got == sorted(((d or -1), t or "") for d, t, _ in brute_lines(rows))
    assert lines.remove_lines(empty).collect() == []
    plan = lines.remove_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lines_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "doc", "hash", "row", "runs", "lines", "pos", "a.b", "__doc", "longest", "Size"]
    kinds = "long, string, string, string, int, string, double, long, string, string, string, int".split(", ")
    rows = [(i, "same\ntwo lines" if i % 2 else f"own {i}", f"d{i}", "h", i, "r", 0.5 * i, i, "dot", "u", "l", -i) for i in range(8)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    found = lines.remove_lines(docs)
    assert found.columns == names
    want = [(r[0], "" if r[0] % 2 and r[0] > 1 else r[1], *r[2:]) for r in rows]
    assert sorted(map(tuple, found.collect())) == want


def test_lines_of_a_very_long_text(spark):
    own = [f"line {i}" for i in range(30_000)]
    rows = [(1, "\n".join(own)), (2, "\n".join(["before", *own[100:29_000], "behind"])), (3, "x" * 5_000_000 + "\n" + "y" * 10)]
    found = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"], r["longest_shared"]) for r in lines.remove_lines(cases.documents(spark, rows), counts=True).collect()}
    assert found == {1: (rows[0][1], 0, 0, 16_384), 2: ("before\nbehind", 28_900, 1, 16_384), 3: (rows[2][1], 0, 0, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_are_in_order(spark, seed):
    rng = random.Random(seed)
    pool = ["line %d" % i for i in range(4)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.9 else f"own {rng.random()}" for _ in range(rng.randint(1, 9)))) for i in range(25)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nmore"), (102, "\n".join(["line 1"] * 9)), rows[4]]
    split = {d: t.split("\n") for d, t in rows}
    suffixes = {(d, i): tuple(ls[i:]) for d, ls in split.items() for i in range(len(ls))}
    firsts: dict = {}
    for s in suffixes.values():
        firsts[s[0]] = firsts.get(s[0], 0) + 1
    found = {(r["doc"], r["pos"]): r for r in lines.order(cases.documents(spark, rows)).collect()}
    assert set(found) == {p for p, s in suffixes.items() if firsts[s[0]] > 1}
    ranked = sorted(found, key=lambda p: found[p]["rank"])
    for x, y in zip(ranked, ranked[1:]):
        assert (found[x]["rank"] == found[y]["rank"]) == (suffixes[x] == suffixes[y])
    assert all(found[p]["rank"] == n for n, p in enumerate(ranked) if not n or found[ranked[n - 1]]["rank"] != found[p]["rank"])
    for h in range(1, 10):  # what shares h lines lies together, so the order is that of some alphabet
        runs = [suffixes[p][:h] for p in ranked if len(suffixes[p]) >= h]
        assert sum(a != b for a, b in zip(runs, runs[1:])) + 1 == len(set(runs)) if runs else True
    for p in found:
        most = max(h for h in (1, 2, 4, 8) if h == 1 or len(suffixes[p]) >= h and sum(s[:h] == suffixes[p][:h] for s in suffixes.values()) > 1)
        assert found[p]["shared"] == most


def plain_ftrl(lists, labels, order, alpha=1.5, beta=1.0, l1=10.0):
    """FTRL-proximal as its authors give it, a coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - (l1 if x > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha)

    heavy = min(4.0, labels.count(0) / labels.count(1))
    for row in order:
        own = [*lists[row], "bias"]
        p = 1 / (1 + np.exp(-sum(map(weight, own))))
        g = (p - labels[row]) * (heavy if labels[row] else 1.0)
        for i, w in [(i, weight(i)) for i in own]:
            step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
            z[i] = z.get(i, 0.0) + g - step * w
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_toxicity_weights_are_those_of_plain_ftrl():
    rng = random.Random(6)
    labels = [int(rng.random() < 0.2) for _ in range(300)]
    lists = [sorted(set(rng.sample(range(40), 6)) | ({50} if y else set())) for y in labels]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = toxicity.learned(ends, np.concatenate(lists), np.array(labels), np.arange(300), 6, 3)
    fixed = np.random.default_rng(7)
    want = plain_ftrl(lists, labels, [i for _ in range(3) for i in fixed.permutation(np.arange(300))])
    assert got[50] > 1 and np.count_nonzero(got) < 41
    assert all(abs(got[64 if i == "bias" else i] - w) < 1e-9 for i, w in want.items())


def test_toxic_rows_go_whatever_the_columns(spark):
    docs = spark.createDataFrame([(1, "calm words", 0.9, "x"), (2, "nasty", 0.1, "y"), (None, None, None, None)], "doc_id long, text string, score double, __toxicity string")
    at = toxicity.features(__import__("pyarrow").array(["nasty"]))[1]
    model = {"at": at, "weight": np.full(len(at), 9.0), "bias": -4.0, "share": None}
    assert sorted(map(tuple, toxicity.below(docs, model, 0.3).collect()), key=str) == [(1, "calm words", 0.9, "x"), (None, None, None, None)]
    with pytest.raises(ValueError):
        toxicity.score(docs, model, keep="__toxicity")


def test_toxicity_finds_what_labels_mark(spark, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        if i % 6 == 0:
            text[rng.randrange(len(text))] = rng.choice(["nasty", "Vile!", "(awful)"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    docs = cases.documents(spark, rows + [(None, "nasty"), (9000, None), (9001, "")])
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known, "toxic")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    hits = [(scored[i] >= 0.3) == bool(y) for i, y in labels if i >= 400]
    assert np.mean(hits) > 0.95
    assert scored[9000] == scored[9001] < 0.3
    assert len(model["at"]) < 500
    kept = toxicity.score(docs, model, keep="__s")
    assert kept.columns == [*docs.columns, "__s"]
    assert toxicity.score(empty, model).collect() == []
    flat = toxicity.train(docs, known.where("false"), "toxic")
    assert {r["score"] for r in toxicity.score(docs, flat).collect()} == {0.0}


def test_toxicity_learns_from_every_label_at_every_size():
    n = 4200
    labels = (np.arange(n) % 10 == 4).astype(np.int64)
    rare = np.arange(n) % 20 == 14  # only in the last of the five folds
    lists = [np.array([1, 3] if r else [1, 2] if y else [1]) for y, r in zip(labels, rare)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = toxicity.fit(ends, np.concatenate(lists), labels, bits=4)
    assert {2, 3} <= set(model["at"].tolist())


BASE = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    return [(n, a, b) for a, _, n, b in sorted((m.start(), i, n, m.end()) for i, (n, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))]


def test_secret_spans(spark, docs, empty):
    model = secrets.train(docs)
    found = secrets.scan(docs, model)

    def one(_, t):
        base = base_spans(t)
        return tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")) + (secrets.joined(base),)

    assert {k: [x[:4] for x in v] for k, v in cases.by_id(found).items()} == cases.expected(one)
    for r in found.collect():
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    assert secrets.scan(empty, secrets.train(empty)).collect() == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert "hunter22" not in clean[170] and clean[170].startswith("password: [secret]\nTOKEN=\"[secret]\"")
    assert clean[140] is None and clean[143] == "one"


def test_secret_network_holds_out(spark):
    model = secrets.CharCnn()
    train, test = secrets.made_up(3000, seed=1), secrets.made_up(1000, seed=2)
    model.fit([w for w, _ in train], np.array([y for _, y in train]))
    model.calibrate([w for w, _ in test[:500]], np.array([y for _, y in test[:500]]), 0.99)
    chances, truth = model.probability([w for w, _ in test[500:]]), np.array([y for _, y in test[500:]])
    assert (chances[truth == 1] >= model.threshold).mean() > 0.96
    assert ((chances >= 0.5) == truth).mean() > 0.95


def test_secret_tokens_with_few_digits(spark):
    assert [t for a, b in secrets.find_tokens("see AbCdEfGhIjKlMnOpQrSt, and aaaaaaaaaaaaaaa1") for t in ["see AbCdEfGhIjKlMnOpQrSt, and aaaaaaaaaaaaaaa1"[a:b]]] == ["AbCdEfGhIjKlMnOpQrSt", "aaaaaaaaaaaaaaa1"]
    model, rng = secrets.CharCnn(), random.Random(4)
    train, test = secrets.made_up(3000, seed=1), secrets.made_up(1000, seed=2)
    model.fit([w for w, _ in train], np.array([y for _, y in train]))
    model.calibrate([w for w, _ in test], np.array([y for _, y in test]), 0.99)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["some words stand before it here: and key " + "".join(rng.choice(signs) for _ in range(36)) + "7 and some words behind" for _ in range(100)]
    assert np.mean([len(spans) for _, spans, _ in secrets.all_spans(texts, model)]) > 0.8


def test_secret_gradients_are_those_of_the_loss():
    model, rng = secrets.CharCnn(), np.random.default_rng(1)
    x = np.frombuffer(b"".join(w for w, _ in secrets.made_up(12)), np.uint8).reshape(-1, secrets.LENGTH)
    labels = np.arange(12) % 2

    def loss():
        z = model._forward(x)[4]
        return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - labels * z))

    grads = model.gradients(x, labels)
    for name, weights in model.p.items():
        flat, own = weights.reshape(-1), grads[name].reshape(-1)
        places = np.unique(np.concatenate([np.argsort(np.abs(own))[-5:], rng.integers(0, len(flat), 5)]))
        for i in places:
            before = flat[i]
            flat[i] = before + 1e-6
            high = loss()
            flat[i] = before - 1e-6
            low = loss()
            flat[i] = before
            assert abs((high - low) / 2e-6 - own[i]) < 1e-6 + 1e-3 * abs(own[i])


def test_secret_network_scores_all_and_adds_what_no_pattern_finds(spark):
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    prose = "and then they went to see what had become of it in the end"
    rows = [(i, f"{prose} {key(36)} {prose} password: {key(20)} {prose}") for i in range(60)] + [(100 + i, prose) for i in range(60)]
    model = secrets.train(cases.documents(spark, rows))
    assert model.held_out["findings"] > 600 and model.held_out["recall"] > 0.96 and model.held_out["false_share"] < 0.1
    found = {r["doc_id"]: r for r in secrets.scan(cases.documents(spark, rows), model).collect()}
    added = [any(s.startswith("model:") for s in found[i]["spans"].split(",")) for i in range(60)]
    assert np.mean(added) > 0.9
    for i in range(60):
        spans = found[i]["spans"].split(",")
        assert len(spans) == len(found[i]["chances"]) and found[i]["base"] in spans and found[i]["n_assign"] == 1
        assert all(0 <= p <= 1 and (p >= model.threshold or not s.startswith("model")) for s, p in zip(spans, found[i]["chances"]))
    assert all(found[100 + i]["spans"] == "" and found[100 + i]["chances"] == [] for i in range(60))


class FixedModel:
    """Takes for a secret, with a chance of 0.4, what has a mark inside; else with one of 0.1."""

    threshold = 0.3

    def probability(self, windows):
        return np.array([0.4 if b"MARK" in w[secrets.LEFT : secrets.LEFT + secrets.INSIDE] else 0.1 for w in windows])


def test_secret_threshold_has_no_floor():
    assert secrets.all_spans(["see abcdefghMARKabcdefgh now", "see abcdefghabcdefghabcd now"], FixedModel()) == [([], [("model", 4, 24)], [0.4]), ([], [], [])]


@pytest.mark.parametrize("before", [0, 17, 36, 37, 40, 79, 150])
@pytest.mark.parametrize("behind", [0, 1, 30, 300])
def test_secret_windows_cover_long_tokens(before, behind):
    token = "x" * (16 + before) + "MARK" + "y" * behind
    assert secrets.all_spans(["see " + "z" * 60 + " or " + token + " now"], FixedModel()) == [([], [("model", 68, 68 + len(token))], [0.4])]


def check_packing(rows, docs_ids, size):
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(docs_ids[d][at : at + r["length"]]) and r["doc_tokens"] == len(docs_ids[d])
            at += r["length"]
        assert at == len(docs_ids[d])
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
    return len(windows)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, empty, ids, size):
    rows = [(d, t) for d, t in {d: t for d, t in cases.texts() if d is not None}.items()]
    own = {d: ids(t) + [1] for d, t in rows}
    found = packing.pack(cases.documents(spark, rows).coalesce(1), JSON, size).collect()
    assert set(own) == {r["doc_id"] for r in found}
    n = check_packing(found, own, size)
    assert n == -(-sum(map(len, own.values())) // size)  # one window at most stays partly filled
    assert packing.pack(empty, JSON).collect() == []
    again = packing.pack(cases.documents(spark, [(None, "x"), (1, "x y"), (1, "x y")]), JSON).collect()
    assert len(again) == 3


def test_level_array_takes_the_smallest_sum_of_squares():
    rng = np.random.default_rng(0)
    p = packing.LevelPacker(20, lambda *_: None)
    for n in rng.integers(1, 20, 300):
        counts = p.counts[1:20].copy()
        options = {}
        for level in [0, *np.flatnonzero(counts) + 1]:
            if level + n <= 20:
                after = counts.copy()
                if level:
                    after[level - 1] -= 1
                if level + n < 20:
                    after[level + n - 1] += 1
                options[level] = int((after**2).sum())
        assert options[p.level(int(n))] == min(options.values())
        p.add(0, np.zeros(n, np.int32))


def test_open_windows_are_bounded():
    out: list = []
    p, rng, most = packing.LevelPacker(20, lambda w, pieces: out.append((w, pieces)), most_open=8), np.random.default_rng(3), 0
    sizes = [11] * 500 + rng.integers(1, 45, 300).tolist()
    for key, n in enumerate(sizes):
        p.add(key, np.arange(n, dtype=np.int32))
        most = max(most, p.held)
        assert p.held == sum(map(len, p.open)) == p.counts.sum()
    p.close()
    assert most <= 8 and len(out) == -(-sum(sizes) // 20) and len({w for w, _ in out}) == len(out)
    found: dict = {}
    for _, pieces in out:
        for key, start, ids in pieces:
            assert ids.tolist() == list(range(start, start + len(ids)))
            found.setdefault(key, []).extend(ids.tolist())
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}


def test_token_store(spark, empty, ids, tmp_path):
    rows = [(d, t) for d, t in {d: t for d, t in cases.texts() if d is not None}.items()]
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(cases.documents(spark, rows), JSON, path)
    want, at = {}, 0
    for d, t in sorted(rows):
        own = ids(t) + [0]
        want[d] = [(at, len(own), crc(own))]
        at += len(own)
    assert cases.by_id(tokenstore.read_store(spark, path)) == want
    assert {r["doc_id"]: bytes(r["ids"]) for r in tokenstore.restore(spark, path).collect()} == {d: np.array(ids(t) + [0], "<u4").tobytes() for d, t in rows}
    assert tokenstore.verify_store(spark, path).collect() == []
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert tokenstore.store_and_read(empty, JSON).collect() == []
    assert tokenstore.store_and_read(cases.documents(spark, [(None, None), (1, "x"), (1, "x")]), JSON).count() == 3


def test_crc_shift():
    rng = np.random.default_rng(0)
    for sizes in ([1, 2, 3], [1000, 1, 70000], [5]):
        blocks = [rng.bytes(n) for n in sizes]
        after = np.cumsum(sizes[::-1])[::-1] - sizes
        parts = tokenstore.crc_shift(np.array([zlib.crc32(b) for b in blocks]), after)
        assert int(np.bitwise_xor.reduce(parts)) == zlib.crc32(b"".join(blocks))


def test_chunks_depend_on_what_they_hold():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 50000, 40000)
    a, b = np.concatenate([rng.integers(0, 50000, 777), body]), body

    def cut(x):
        at = tokenstore.cuts(x, np.array([0, len(x)]))
        return {x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])}

    assert len(cut(a) & cut(b)) > 0.9 * len(cut(b))


def test_words_hash_as_words_do():
    import pyarrow as pa

    from tonegrid.llm.words import word_hashes

    texts = ["Hello  World\thello", "", None, "a", " world ", "x\x0by\x0cz   É"]
    ends, hashes = word_hashes(pa.array(texts))
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("H", "h").replace("W", "w"))]
    assert len(words) == len(hashes) == ends[-1]
    assert len(set(words)) == len(set(hashes.tolist())) and all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_ranks_file():
    assert base64.b64encode(next(k for k, v in bpe.ranks(RANKS).items() if v == 0))


def test_token_store_sees_exchanged_recipes(spark, tmp_path):
    path = f"{tmp_path}/store"
    tokenstore.write_store(cases.documents(spark, [(1, "some words"), (2, "other words than these")]), JSON, f"file://{path}")
    recipes = spark.read.parquet(f"file://{path}/recipes").toPandas().sort_values("doc_id")
    for taken in (["keys"], ["keys", "sizes", "root"]):
        changed = recipes.copy()
        changed[taken] = recipes[taken].to_numpy()[::-1]
        spark.createDataFrame(list(changed[[c.split()[0] for c in tokenstore.RECIPES.split(", ")]].itertuples(index=False, name=None)), tokenstore.RECIPES).write.mode("overwrite").parquet(f"file://{path}/recipes")
        with pytest.raises(Exception, match="isn't what was stored|don't agree with the manifest"):
            tokenstore.read_store(spark, f"file://{path}").collect()
