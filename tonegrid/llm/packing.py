"""Packing of token ids into windows by the sum-of-squares rule.

pack(): each input partition is one online packer. Documents longer than a window fill whole windows first;
the rest goes to the fill level that leaves the smallest sum of squared counts of partially filled windows.
Only open windows are held, by level, and `most_open` of them at most (32 MB of ids with windows of 2048): beyond that, and when the
partition ends, the emptiest of them are cut up to fill the fullest, at the end until one window at most stays partly filled. Nothing is
shuffled, and a lost task is simply run again.

Null text: empty, so only the end id. Null doc_id: packed, and kept as null. Repeated rows: packed each. Ties: the fullest of the best
levels. Very long texts: whole windows first, as they come. Empty table: no rows. Other columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, partition_id, texts
from .pieces import file_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Open windows that a packer holds at most.
MOST_OPEN = 4096


class LevelPacker:
    """Online sum-of-squares packing. done: gets (window, pieces) for each full window; a piece is (key, start, ids)."""

    def __init__(self, size: int, done, most_open: int = MOST_OPEN):
        self.size, self.done, self.windows, self.most_open, self.held = size, done, 0, most_open, 0
        self.counts = np.zeros(size + 1, np.int64)  # the level array: open windows by fill
        self.open: list[list] = [[] for _ in range(size + 1)]

    def level(self, length: int) -> int:
        """The fill level (0: a new window) that minimises the sum of squared counts; the fullest of the best."""
        counts, size = self.counts, self.size
        now = counts[1 : size - length + 1]
        after = 2 * counts[1 + length : size + 1] + 1
        if len(after):
            after[-1] = 0  # full windows don't count
        change = np.where(now > 0, after - 2 * now + 1, np.iinfo(np.int64).max)
        new = 2 * int(counts[length]) + 1 if length < size else 0
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= new:
                return best + 1
        return 0

    def add(self, key, ids: np.ndarray) -> None:
        at, size = 0, self.size
        while len(ids) - at >= size:
            self.done(self._new(), [(key, at, ids[at : at + size])])
            at += size
        if at < len(ids):
            self._place(key, at, ids[at:])

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def _place(self, key, start: int, ids: np.ndarray) -> None:
        level = self.level(len(ids))
        if level:
            self.counts[level] -= 1
            window, pieces = self.open[level].pop()
            self.held -= 1
        else:
            window, pieces = self._new(), []
        pieces.append((key, start, ids))
        self._keep(window, pieces, level + len(ids))

    def _keep(self, window: int, pieces: list, fill: int) -> None:
        if fill == self.size:
            self.done(window, pieces)
        else:
            self.counts[fill] += 1
            self.open[fill].append((window, pieces))
            self.held += 1
            if self.held > self.most_open:
                self.settle(self.most_open // 2)

    def close(self) -> None:
        """Settle until one window at most is partly filled, and give that out, too."""
        self.settle(0)

    def settle(self, keep: int) -> None:
        """Fill the fullest open windows with what the emptiest hold, cut to fit, until `keep` are left open; with 0 all are given out."""
        rest = [(fill, window, pieces) for fill in range(self.size - 1, 0, -1) for window, pieces in self.open[fill]]
        low, high = 0, len(rest) - 1
        while low < high and high - low + 1 > keep:
            fill, window, pieces = rest[low]
            gap, (left, other, source) = self.size - fill, rest[high]
            key, start, ids = source[-1]
            take = min(gap, len(ids))
            pieces.append((key, start + len(ids) - take, ids[len(ids) - take :]))
            source[-1] = (key, start, ids[: len(ids) - take])
            if take == len(ids):
                source.pop()
            rest[low], rest[high] = (fill + take, window, pieces), (left - take, other, source)
            if fill + take == self.size:
                self.done(window, pieces)
                low += 1
            if left == take:
                high -= 1
        self.counts[:], self.held = 0, 0
        self.open = [[] for _ in range(self.size + 1)]
        for fill, window, pieces in rest[low : high + 1]:
            if pieces and keep:
                self.counts[fill] += 1
                self.open[fill].append((window, pieces))
                self.held += 1
            elif pieces:
                self.done(window, pieces)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each piece of a document's ids (with end_id): where it starts there, its length and crc32, and its place in a window."""
    if size < 1 or most_open < 2:
        raise ValueError("size must be positive, and most_open at least 2")
    arrow(docs.sparkSession)

    def run(batches):
        encode, base, rows, tokens = file_encoder(tokenizer), partition_id() << 40, [], {}

        def done(window: int, pieces: list) -> None:
            offset = 0
            for (row, doc_id, total), start, ids in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + window, offset))
                offset += len(ids)

        def flush():
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        packer = LevelPacker(size, done, most_open)
        for batch in batches:
            ends, ids = encode(batch["text"])
            ids = ids.astype(np.int32)
            for i, doc_id in enumerate(batch["doc_id"].to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.int32(end_id))
                packer.add((i, doc_id, len(own)), own)
            if len(rows) > 5000:
                yield flush()
        packer.close()
        yield flush()

    return texts(docs).mapInArrow(run, SCHEMA)
