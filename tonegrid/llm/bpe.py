"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Pre-tokens are counted off within blocks of documents (an input partition, or part of a large one): a block names each of
its distinct words once, and a document is the list of its words' numbers, by position. The words of all blocks meet,
sorted, so that each distinct word is encoded once; its ids go back to the blocks that named it, where documents are
put together by position. Decoding joins the token-byte table, which has as many rows as the vocabulary: decode() as a broadcast join
of ids by position; encode() within its blocks, once for each distinct word.

The documents pass twice, once for their words and once for their positions, so that neither is shuffled with the other. The second pass
carries a digest of each block's words; the words decoded from the ids that came back must give the same one, else the block is an error.

Null text: empty, no ids. Repeated rows: encoded each. Null doc_id: kept. Very long texts: one block, in one task. Empty table: no rows.
Other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, parts, partition_id, ragged, stored, text_bytes, texts
from .pieces import SETTLED, Pieces

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of text that a block should hold: the larger, the fewer words are named twice. Bits of a word's number, and of a block's within its partition.
BLOCK_BYTES, NUMBER_BITS, BLOCK_BITS = 48 << 20, 28, 12
WORDS = "word binary, place long"
CODED = "block long, numbers binary, lengths binary, ids binary"
PLACED = "block long, doc_ids binary, nulls binary, ends binary, numbers binary, digest binary"


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line for each, base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Words:
    """Numbers the distinct words of a block in order of first use."""

    def __init__(self, pattern: str):
        self.cut, self.pieces = regex.compile(pattern).findall, Pieces(self._number, limit=1 << 62)
        self.seen: dict[str, int] = {}

    def _number(self, piece: str) -> bytes:
        # Where Unicode versions may differ, the piece stays whole and the encoder itself cuts it.
        words = self.cut(piece) if not piece or max(piece) < SETTLED else [piece]
        return array("i", [self.seen.setdefault(w, len(self.seen)) for w in words]).tobytes()

    def digest(self) -> bytes:
        return hashlib.blake2b("\0".join(self.seen).encode(), digest_size=16).digest()


def blocks(batches, pattern: str, most: int):
    """(block id, Words, doc_ids, ends, numbers) of each run of batches with about `most` bytes of text."""
    held, size, n = [], 0, 0
    words = Words(pattern)

    def out():
        doc_ids = pa.concat_arrays([b for b, _, _ in held])
        ends = np.concatenate([np.zeros(1, np.int64), *(e[1:] + s for (_, e, _), s in zip(held, np.cumsum([0, *(len(x) for _, _, x in held[:-1])])))])
        if n >> BLOCK_BITS or len(words.seen) >> NUMBER_BITS:
            raise ValueError("too many blocks in a partition, or words in a block")
        return (partition_id() << BLOCK_BITS) + n, words, doc_ids, ends, np.concatenate([x for _, _, x in held])

    for batch in batches:
        if not len(batch):
            continue
        ends, numbers = words.pieces(batch["text"])
        held.append((batch["doc_id"], ends, numbers.astype(np.int32)))
        size += batch["text"].nbytes
        if size >= most:
            yield out()
            held, size, n, words = [], 0, n + 1, Words(pattern)
    if held:
        yield out()


def encode(docs: DataFrame, rank_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: n_tokens, sha256 of its ids (decimal, joined by commas) and of the bytes decoded from them."""
    return _joined(docs, rank_path, pattern, block_bytes, _digests, SCHEMA)


def encode_ids(docs: DataFrame, rank_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: its ids and the bytes decoded from them."""
    return _joined(docs, rank_path, pattern, block_bytes, _whole, "doc_id long, ids array<int>, decoded binary")


def token_bytes(spark: SparkSession, rank_path: str) -> DataFrame:
    """The token-byte table: id and token, a row for each entry of the vocabulary."""
    table = ranks(rank_path)
    return spark.createDataFrame(pa.table({"id": pa.array(table.values(), pa.int32()), "token": pa.array(table.keys(), pa.binary())}))


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id and text bytes of rows with doc_id and ids, in any order: ids join the token-byte table and are put together by position. Ids
    that the table doesn't have give nothing; a null list of ids is an empty text. Equal rows are decoded each."""
    rows = encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "ids")  # the ids of rows must be the same on both sides of the join below
    spread = rows.select("row", F.posexplode("ids").alias("pos", "id"))
    joined = spread.join(F.broadcast(token_bytes(encoded.sparkSession, rank_path)), "id")
    whole = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x")).select("row", F.unhex(F.array_join(F.transform("x.token", F.hex), "")).alias("decoded"))
    return rows.select("doc_id", "row").join(whole, "row", "left").select("doc_id", F.coalesce("decoded", F.lit(b"")).alias("decoded"))


_tables: dict[str, list[bytes]] = {}


def _token_bytes(path: str) -> list[bytes]:
    if path not in _tables:
        by_id = {i: token for token, i in ranks(path).items()}
        _tables[path] = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return _tables[path]


def _digests(doc_ids, ends, starts, flat, numbers, words) -> pa.RecordBatch:
    word_ids = np.split(flat, starts[1:-1]) if len(starts) > 2 else [flat]
    # Each word's ids as decimal text with a comma after each: written once for each word of the block.
    text = [("," .join(map(str, ids)) + ",").encode() if len(ids) else b"" for ids in (w.tolist() for w in word_ids)]
    counts = np.concatenate([[0], np.cumsum(np.diff(starts)[numbers])])[ends] if len(numbers) else np.zeros(len(ends), np.int64)
    rows = []
    for a, b in zip(ends[:-1], ends[1:]):
        own = numbers[a:b].tolist()
        joined = b"".join(map(text.__getitem__, own))
        rows.append((hashlib.sha256(joined[:-1]).hexdigest(), hashlib.sha256(b"".join(map(words.__getitem__, own))).hexdigest()))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(counts), pa.int64()), pa.array(columns[0]), pa.array(columns[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _whole(doc_ids, ends, starts, flat, numbers, words) -> pa.RecordBatch:
    lengths = np.diff(starts)
    ids = [flat[ragged(starts[numbers[a:b]], lengths[numbers[a:b]])].astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]
    decoded = [b"".join(map(words.__getitem__, numbers[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])


def _joined(docs: DataFrame, rank_path: str, pattern: str, block_bytes: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    arrow(spark)
    docs = texts(docs)
    total = text_bytes(docs)

    def words(batches):
        for block, found, *_ in blocks(batches, pattern, block_bytes):
            names = [w.encode() for w in found.seen]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array((block << NUMBER_BITS) + np.arange(len(names)))], names=["word", "place"])

    def placed(batches):
        for block, found, doc_ids, ends, numbers in blocks(batches, pattern, block_bytes):
            nulls = np.array([x is None for x in doc_ids.to_pylist()], bool).tobytes()
            raw = (doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls, ends.astype("<i8").tobytes())
            packed = pa.compress(_thin(numbers), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block])] + [pa.array([x], pa.binary()) for x in (*raw, packed, found.digest())], names=["block", "doc_ids", "nulls", "ends", "numbers", "digest"])

    def coded(batches):
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(rank_path), special_tokens={})
        single, plain = encoder._core_bpe.encode_single_piece, regex.compile(pattern)
        last: tuple = (None, ())
        for batch in batches:
            unique = batch["word"].dictionary_encode()
            ids = []
            for word in unique.dictionary.to_pylist():
                if word != last[0]:  # sorted, so a word that goes on over batches comes first
                    text = word.decode()
                    last = (word, single(word) if max(text) < SETTLED and plain.fullmatch(text) else encoder.encode_ordinary(text))
                ids.append(last[1])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
            starts = np.cumsum(lengths) - lengths
            codes, place = unique.indices.to_numpy(), batch["place"].to_numpy()
            block, number = place >> NUMBER_BITS, (place & ((1 << NUMBER_BITS) - 1)).astype("<i4")
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1)) if len(order) else []
            out: list[list] = [[], [], [], []]
            for a, b in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:b]
                own = codes[rows]
                for column, x in zip(out, (int(block[rows[0]]), number[rows].tobytes(), lengths[own].astype("<u2" if lengths.max() < 65536 else "<i4").tobytes(), flat[ragged(starts[own], lengths[own])].astype("<i4").tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["block", "numbers", "lengths", "ids"])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, table, out = left.to_pylist(), _token_bytes(rank_path), []
        if len(doc) != 1:
            raise ValueError("the input gave other rows when it was read again")
        doc = doc[0]
        ends, numbers = np.frombuffer(doc["ends"], "<i8"), _fat(pa.decompress(doc["numbers"], _fat_size(doc), codec="zstd", asbytes=True))
        at, size, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for row in right.to_pylist():
            at.append(np.frombuffer(row["numbers"], "<i4"))
            wide = len(row["lengths"]) == len(row["numbers"])
            size.append(np.frombuffer(row["lengths"], "<i4" if wide else "<u2").astype(np.int64))
            ids.append(np.frombuffer(row["ids"], "<i4"))
        at, size, ids = map(np.concatenate, (at, size, ids))
        order = np.argsort(at, kind="stable")
        if len(at) != (int(numbers.max()) + 1 if len(numbers) else 0) or not np.array_equal(at[order], np.arange(len(at))):
            raise ValueError("the input gave other words when it was read again")
        begins = np.cumsum(size) - size
        flat = ids[ragged(begins[order], size[order])]
        starts = np.concatenate([[0], np.cumsum(size[order])])
        every = list(map(table.__getitem__, flat.tolist()))
        words_ = [b"".join(every[a:b]) for a, b in pairwise(starts.tolist())]
        if hashlib.blake2b(b"\0".join(words_), digest_size=16).digest() != doc["digest"]:
            raise ValueError("the input gave other words when it was read again, or their ids don't decode to them")
        doc_ids = pa.array(np.frombuffer(doc["doc_ids"], "<i8"), mask=np.frombuffer(doc["nulls"], bool))
        return pa.Table.from_batches([finish(doc_ids, ends, starts, flat, numbers, words_)])

    n = parts(spark, total, 32 << 20)
    named = docs.mapInArrow(words, WORDS)
    answers = named.repartition(n, "word").sortWithinPartitions("word").mapInArrow(coded, CODED)
    by_block = lambda rows: rows.repartition(n, "block").groupBy("block")  # noqa: E731  as many tasks as the input needs
    return by_block(docs.mapInArrow(placed, PLACED)).cogroup(by_block(answers)).applyInArrow(together, schema)


def _thin(numbers: np.ndarray) -> bytes:
    """Numbers as their low bytes, then the next, and so on: frequent words have small numbers, so the upper planes shrink well."""
    wide = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(wide.T).tobytes()


def _fat_size(doc: dict) -> int:
    return int(np.frombuffer(doc["ends"], "<i8")[-1]) * 4


def _fat(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
