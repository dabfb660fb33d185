"""Removal of repeated byte strings by a prefix-free parse whose dictionary is put into suffix order.

Parse. A rolling hash runs over TRIGGER bytes; in each string of `length` bytes the smallest hash is its trigger. Strings in a row with
the same trigger are one phrase: their bytes, from the first string's start to the last one's end. Triggers depend on nothing
but the string itself, so equal strings lie in phrases of equal triggers, at equal distance from it, wherever they stand: parsing is
free of prefixes and of context, and phrases with different triggers never have to be compared.

1. Triggers: blocks of documents name their distinct trigger hashes (5 bytes each), dealt by hash; those that one
   document alone has are left out from here on.
2. Dictionary: blocks name their distinct phrases with a common trigger and the smallest doc_id of each, dealt by trigger. Equal
   phrases become one dictionary entry. Where a trigger has several entries, the suffixes of these entries (those that begin a string) are sorted:
   the suffix array of the dictionary, to the depth of `length`. As a phrase carries what follows its last string's start, the order of
   the parse beyond it isn't needed: neighbours in the array with a common prefix of `length` are one string, and the
   parse (for each block, the documents' phrases as entry numbers with their smallest doc_id) gives its first document.
3. Each block gets for each of its phrases a bit for each string that an earlier document of another block has; within the
   block the entry numbers tell. Covered bytes are summed up by document.

A trigger that all documents have costs a block one entry for each distinct phrase, not one for each occurrence. Texts travel
compressed, by block. Everything is found from whole texts, and compared byte by byte.

Null and empty texts: nothing to remove. Texts below `length`: likewise. Documents with a null doc_id: keep all, and nothing is
removed on their account. Repeated doc_ids: none is smaller, so they don't remove each other's strings. Very long texts: one block
holds at least one text; beyond 2 ** 23 bytes it is parsed in overlapping parts. Empty table: no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, buffers, mix, parts, partition_id, ragged, text_bytes, texts
from .words import _power

TRIGGER = 24
KEY_BYTES = 5
#: Bytes of text in a block: a block's phrases, with the bytes that overlap, take up to ten times as much. Bytes of a dictionary's share.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: Bytes that the rolling hash takes at a time: documents are joined up to this size.
STRETCH = 1 << 20
NO_DOC = np.iinfo(np.int64).max


def parse(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts that lie one after the other: where the first string of each starts, how many strings it has, its trigger's hash (40 bits)."""
    starts, counts, keys = [], [], []
    at, n = 0, len(ends) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
        for lo, hi, cut in _stretches(ends, at, stop, length):
            s, c, k = _phrases(raw[lo:hi], cut - lo, length)
            starts.append(s + lo)
            counts.append(c)
            keys.append(k)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def _stretches(ends: np.ndarray, at: int, stop: int, length: int):
    """Bytes [lo, hi) and the ends of texts there; a text beyond 2 ** 23 bytes comes in overlapping parts, whose strings are each in one part."""
    if stop > at + 1 or ends[stop] - ends[at] <= 1 << 23:
        yield ends[at], ends[stop], ends[at + 1 : stop + 1]
        return
    for lo in range(int(ends[at]), int(ends[stop]), 1 << 22):
        hi = min(lo + (1 << 22) + length - 1, int(ends[stop]))
        yield lo, hi, np.array([hi])


def _phrases(raw: np.ndarray, ends: np.ndarray, length: int):
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = len(raw)
    if size < length:
        return none
    power, inverse = _power(size + 1)
    summed = np.empty(size + 1, np.uint64)
    summed[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:size], out=summed[1:])
    spots = size - TRIGGER + 1
    hashed = mix((summed[TRIGGER:] - summed[:spots]) * inverse[:spots])
    # The hash above, the place below: the smallest is the leftmost of the smallest hashes.
    low = (hashed & ~np.uint64((1 << 24) - 1)) | np.arange(spots, dtype=np.uint64)
    span = length - TRIGGER + 1
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    begins = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(low) + 1, np.int32)
    fits = ends - begins >= length
    whole[begins[fits]] += 1
    whole[ends[fits] - length + 1] -= 1
    valid = np.cumsum(whole[:-1]) > 0
    where = np.flatnonzero(valid)
    if not len(where):
        return none
    low = low[where]
    new = np.ones(len(where), bool)
    new[1:] = (low[1:] != low[:-1]) | (where[1:] != where[:-1] + 1)
    new |= np.isin(where, begins)  # phrases never cross texts
    first = np.flatnonzero(new)
    return where[first], np.diff(np.append(first, len(where))), low[first] >> np.uint64(24)


def _thin(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _fat(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").reshape(-1)


def _blocks(batches, most: int):
    """(block id, doc_ids, ends, bytes) of runs of batches with about `most` bytes."""
    held, size, n = [], 0, 0

    def out():
        docs, spans, raw = zip(*held)
        shifts = np.cumsum([0, *(len(r) for r in raw[:-1])])
        ends = np.concatenate([np.zeros(1, np.int64), *(e[1:] + s for e, s in zip(spans, shifts))])
        return (partition_id() << 24) + n, pa.concat_arrays(docs), ends, np.concatenate(raw)

    for batch in batches:
        if len(batch):
            held.append((batch["doc_id"], *buffers(batch["text"])))
            size += len(held[-1][2])
        if size >= most:
            yield out()
            held, size, n = [], 0, n + 1
    if held:
        yield out()


def _digest(ends: np.ndarray, doc_ids: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ends.tobytes() + doc_ids.tobytes(), digest_size=7).digest(), "little")


#: Bytes, or strings, that are gathered at a time: indexes take eight times as much.
GATHER = 1 << 20


def _portions(lengths: np.ndarray):
    """Ranges of places whose lengths add up to about GATHER."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GATHER, "right")))
        yield at, stop
        at = stop


def _slices(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of raw, one after the other."""
    out, at = np.empty(int(lengths.sum()), np.uint8), 0
    for a, b in _portions(lengths):
        index = ragged(starts[a:b], lengths[a:b])
        out[at : at + len(index)] = raw[index]
        at += len(index)
    return out


class Block:
    """A block's documents, and their phrases with triggers among `common` (sorted hashes)."""

    def __init__(self, row: dict, length: int):
        self.length = length
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")  # NO_DOC: null
        self.raw = np.frombuffer(pa.decompress(row["raw"], int(self.ends[-1]), codec="zstd", asbytes=True), np.uint8) if self.ends[-1] else np.zeros(0, np.uint8)

    def take(self, common: np.ndarray) -> None:
        starts, counts, keys = parse(self.raw, self.ends, self.length)
        doc = self.doc_ids[np.searchsorted(self.ends, starts, "right") - 1]
        at = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
        keep = (common[at] == keys) & (doc != NO_DOC) if len(common) else np.zeros(len(keys), bool)
        self.starts, self.counts, self.keys, self.doc = starts[keep], counts[keep], keys[keep], doc[keep]
        # Entries: distinct phrases of the block, in order of first use.
        sizes = self.counts + self.length - 1
        data = _slices(self.raw, self.starts, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        coded = column.dictionary_encode()
        self.entry = coded.indices.to_numpy().astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        n = len(coded.dictionary)
        self.first = np.full(n, NO_DOC)
        np.minimum.at(self.first, self.entry, self.doc)
        self.sample = np.zeros(n, np.int64)
        self.sample[self.entry[::-1]] = np.arange(len(sizes))[::-1]

    def phrases(self, block: int, buckets: int):
        """A row for each bucket: the entries' numbers, triggers, counts of strings, smallest doc_ids and bytes."""
        of = (mix(self.keys[self.sample]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            entries = order[a:b]
            at = self.sample[entries]
            data = _slices(self.raw, self.starts[at], self.counts[at] + self.length - 1).tobytes()
            yield int(of[entries[0]]), block, entries.astype("<i4").tobytes(), _thin(self.keys[at]), self.counts[at].astype(np.uint8).tobytes(), self.first[entries].astype("<i8").tobytes(), len(data), pa.compress(data, codec="zstd", asbytes=True)

    def covered(self, masks: np.ndarray) -> np.ndarray:
        """Which bytes go: masks has for each entry a bit for each string that an earlier block's document has."""
        step = np.zeros(len(self.raw) + 1, np.int32)
        for a, b in _portions(self.counts):
            counts, entry = self.counts[a:b], self.entry[a:b]
            begin = ragged(self.starts[a:b], counts)
            bit = ragged(np.zeros(b - a, np.int64), counts).astype(np.uint64)
            earlier = np.repeat(self.doc[a:b] > self.first[entry], counts) | ((np.repeat(masks[entry], counts) >> bit) & np.uint64(1)).astype(bool)
            gone = begin[earlier]
            step[gone] += 1  # each string begins but once
            step[gone + self.length] -= 1
        return np.cumsum(step[:-1]) > 0


def order_strings(entries: np.ndarray, raw: np.ndarray, begins: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of dictionary entries, to the depth of `length`: for each suffix in order, its entry, its number there, and
    whether its first `length` bytes differ from those of the one before."""
    begin = ragged(begins[entries], counts[entries])
    entry = np.repeat(entries, counts[entries])
    number = ragged(np.zeros(len(entries), np.int64), counts[entries])
    words = -(-length // 8)
    keys = []
    for w in range(words):
        word = np.zeros(len(begin), np.uint64)
        for j in range(8 * w, min(8 * w + 8, length)):
            word |= raw[begin + j].astype(np.uint64) << np.uint64(56 - 8 * (j - 8 * w))
        keys.append(word)
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    for word in keys:
        sorted_word = word[order]
        differs[1:] |= sorted_word[1:] != sorted_word[:-1]
    differs[:1] = True
    return entry[order], number[order], differs


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES, texts_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; with texts_too also kept (the remaining bytes)."""
    if not TRIGGER <= length <= TRIGGER + 63:
        raise ValueError(f"length must lie between {TRIGGER} and {TRIGGER + 63}")
    spark = docs.sparkSession
    arrow(spark)
    docs = texts(docs)
    total = text_bytes(docs)
    buckets, n = parts(spark, total, BUCKET_BYTES), parts(spark, total, 16 << 20)
    dealt = lambda rows, key: rows.repartition(n, key).groupBy(key)  # noqa: E731  as many tasks as the input needs

    def ids(column: pa.Array) -> np.ndarray:
        return column.fill_null(NO_DOC).to_numpy().astype("<i8")

    def triggers(batches):
        for block, doc_ids, ends, raw in _blocks(batches, block_bytes):
            starts, _, keys = parse(raw, ends, length)
            own = ids(doc_ids)
            doc = np.searchsorted(ends, starts, "right") - 1
            rank = np.unique(own, return_inverse=True)[1]  # equal doc_ids count as one document
            pairs = np.unique((keys << np.uint64(24)) | rank[doc].astype(np.uint64))
            distinct, counts = np.unique(pairs >> np.uint64(24), return_counts=True)
            of = (mix(distinct) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1))
            rows = [(int(of[order[a]]), block, _digest(ends, own), _thin(distinct[order[a:b]][counts[order[a:b]] == 1]), _thin(distinct[order[a:b]][counts[order[a:b]] > 1])) for a, b in zip(edges, [*edges[1:], len(order)])]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=["bucket", "block", "digest", "once", "often"])

    def common(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        parts_ = [(_fat(r["once"]), _fat(r["often"])) for r in rows]
        every = np.concatenate([x for p in parts_ for x in (p[0], p[1], p[1])])
        every.sort()
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for r, (once, often) in zip(rows, parts_):
            at = np.minimum(np.searchsorted(shared, once), max(len(shared) - 1, 0))
            own = np.concatenate([often, once[shared[at] == once]]) if len(shared) else often
            if len(own):
                out.append((r["block"], r["digest"], _thin(own)))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({"block": pa.array(columns[0], pa.int64()), "digest": pa.array(columns[1], pa.int64()), "keys": pa.array(columns[2], pa.binary()), "entries": pa.nulls(len(out), pa.binary()), "masks": pa.nulls(len(out), pa.binary())})

    def packed(batches):
        for block, doc_ids, ends, raw in _blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids(doc_ids).tobytes()]), pa.array([ends.astype("<i8").tobytes()]), pa.array([pa.compress(raw.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["block", "doc_ids", "ends", "raw"])

    def opened(left: pa.Table, right: pa.Table) -> tuple[int, Block, pa.Table]:
        rows = left.to_pylist()
        if len(rows) != 1:
            raise ValueError("the input gave other blocks when it was read again")
        block = Block(rows[0], length)
        digest = _digest(block.ends, block.doc_ids)
        if any(d is not None and d != digest for d in right["digest"].unique().to_pylist()):
            raise ValueError("the input gave other documents when it was read again")
        block.take(np.sort(np.concatenate([np.zeros(0, np.uint64), *(_fat(k) for k in right["keys"].to_pylist() if k)])))
        return rows[0]["block"], block, right

    names = ["bucket", "block", "entries", "keys", "counts", "first", "size", "raw"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        number, block, _ = opened(left, right)
        columns = list(zip(*block.phrases(number, buckets))) or [()] * 8
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    def dictionary(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        counts, first, keys = (np.concatenate(x) for x in zip(*((np.frombuffer(r["counts"], np.uint8).astype(np.int64), np.frombuffer(r["first"], "<i8"), _fat(r["keys"])) for r in rows)))
        data = b"".join(pa.decompress(r["raw"], r["size"], codec="zstd", asbytes=True) for r in rows)
        begins = np.concatenate([[0], np.cumsum(counts + length - 1)])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(begins.astype(np.int64).tobytes()), pa.py_buffer(data)])
        entry = column.dictionary_encode().indices.to_numpy().astype(np.int64)
        n = int(entry.max()) + 1
        least = np.full(n, NO_DOC)
        np.minimum.at(least, entry, first)
        sample = np.zeros(n, np.int64)
        sample[entry[::-1]] = np.arange(len(entry))[::-1]
        masks = np.zeros(len(counts), np.uint64)
        full = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
        masks[least[entry] < first] = full[least[entry] < first]
        # Triggers with several entries: their suffixes in order, and the smallest doc_id of each common prefix.
        _, of, many = np.unique(keys[sample], return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[of] > 1)
        if len(several):
            raw = np.frombuffer(data, np.uint8)
            own, number, new = order_strings(several, raw, begins[sample], counts[sample], length)
            heads = np.flatnonzero(new)
            lowest = np.repeat(np.minimum.reduceat(least[own], heads), np.diff(np.append(heads, len(own))))
            # For each string of an entry its smallest doc_id; then for each block's entry the strings with a smaller one.
            table = np.full((n, int(counts.max())), NO_DOC)
            table[own, number] = lowest
            rows_ = np.flatnonzero(np.isin(entry, several))
            for a in range(0, len(rows_), 1 << 16):
                some = rows_[a : a + (1 << 16)]
                smaller = table[entry[some]] < first[some, None]
                bits = (smaller.astype(np.uint64) << np.arange(table.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
                masks[some] |= bits & full[some]
        out, at = [], 0
        for r in rows:
            numbers = np.frombuffer(r["entries"], "<i4")
            own = masks[at : at + len(numbers)]
            at += len(numbers)
            if own.any():
                out.append((r["block"], numbers[own > 0].tobytes(), own[own > 0].astype("<u8").tobytes()))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({"block": pa.array(columns[0], pa.int64()), "digest": pa.nulls(len(out), pa.int64()), "keys": pa.nulls(len(out), pa.binary()), "entries": pa.array(columns[1], pa.binary()), "masks": pa.array(columns[2], pa.binary())})

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block, right = opened(left, right)
        masks = np.zeros(len(block.first), np.uint64)
        for entries, own in zip(right["entries"].to_pylist(), right["masks"].to_pylist()):
            if entries:
                masks[np.frombuffer(entries, "<i4")] = np.frombuffer(own, "<u8")
        gone = block.covered(masks)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = block.ends[:-1][block.ends[:-1] < len(gone)]
        edge[inner] = gone[inner]  # runs end with their text
        removed = np.concatenate([[0], np.cumsum(gone)])[block.ends]
        spans = np.concatenate([[0], np.cumsum(edge)])[block.ends]
        kept = block.raw[~gone]
        at = block.ends - removed
        parts_ = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        out = {
            "doc_id": pa.array(block.doc_ids, mask=block.doc_ids == NO_DOC), "n_bytes": pa.array(np.diff(block.ends)), "n_removed": pa.array(np.diff(removed)), "n_spans": pa.array(np.diff(spans)),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts_], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(parts_, pa.binary())} if texts_too else {}))

    reply = "block long, digest long, keys binary, entries binary, masks binary"
    named = docs.mapInArrow(triggers, "bucket long, block long, digest long, once binary, often binary")
    shared = dealt(named, "bucket").applyInArrow(common, reply)
    packs = docs.mapInArrow(packed, "block long, doc_ids binary, ends binary, raw binary")
    found = dealt(packs, "block").cogroup(dealt(shared, "block")).applyInArrow(phrases, "bucket long, block long, entries binary, keys binary, counts binary, first binary, size long, raw binary")
    answers = dealt(found, "bucket").applyInArrow(dictionary, reply)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too
    return dealt(packs, "block").cogroup(dealt(shared.unionByName(answers), "block")).applyInArrow(finished, schema)
