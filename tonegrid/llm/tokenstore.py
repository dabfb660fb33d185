"""A content-addressed store of token ids.

write_store(): ids (with an end id) are cut into chunks where a rolling hash over the last ids has zero low bits,
so equal passages give equal chunks; each distinct chunk is stored once under its hash. A document is a recipe: the hashes
of its chunks, in order. Recipes lie in files by ascending doc_id, with the number of ids before each; a Merkle manifest has
for each recipe file the root over its documents' roots, which are the roots over their chunk hashes.

Files (Parquet, below one path): objects/kind=chunk (key, n, payload: zstd of little-endian ids), objects/kind=recipe
(as written), recipes (doc_id, start, n_tokens, keys, sizes, root; sorted), manifest (file, n_docs, n_tokens, start, root).

read_store(): recomputes roots from the recipes and compares them with those of the recipes and of the manifest before anything is read,
reads all chunks back, checks each against its hash, and derives each document's crc32 from those of
its chunks (crc32 is linear, so a chunk's part is its crc32 shifted by the bytes after it): only keys are shuffled, never ids.
verify_store(): recomputes roots and compares them with the manifest. restore(): ids of documents.

Null text: empty, so only the end id. Repeated rows: stored each, chunks shared; among equal doc_ids the smaller root comes
first. A null doc_id comes first. Very long texts: encoded whole in one task, cut into chunks like any other. Empty table: empty files. Other
columns are ignored."""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, mix, new_path, parts, text_bytes, texts
from .pieces import file_encoder

#: ids that the rolling hash sees, and its bits that must be zero: chunks of 2 ** BITS ids on average.
SPAN, BITS, MOST = 4, 10, 1 << 14
_NOISE = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
KEY_BYTES = 16
OBJECTS = "key binary, kind string, doc_id long, n long, payload binary, sizes binary, root binary"


def cuts(ids: np.ndarray, ends: np.ndarray, span: int = SPAN, bits: int = BITS, most: int = MOST) -> np.ndarray:
    """Where chunks end, in all documents: ends has len(documents) + 1 offsets into ids."""
    noise = _NOISE[ids & 0xFFFF]
    rolled = noise.copy()
    for j in range(1, span):
        rolled[j:] += noise[: len(ids) - j] * np.uint32(2 * j + 1)
    hits = np.flatnonzero((rolled * np.uint32(2654435761)) >> np.uint32(32 - bits) == 0)
    hits = hits[hits - ends[np.searchsorted(ends, hits, "right") - 1] >= span]  # so that the hash never sees the document before
    found = np.union1d(hits + 1, ends)
    lengths = np.diff(found)
    if len(lengths) and lengths.max() > most:  # a long stretch without a hit is cut at fixed steps from its start
        more = np.concatenate([np.arange(a, b, most) for a, b in zip(found[:-1], found[1:]) if b - a > most])
        found = np.union1d(found, more)
    return found


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree with sha256; an odd node goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _expand(payload: bytes, n: int, wide: bool, reader=None) -> np.ndarray:
    return np.frombuffer((reader or zstandard.ZstdDecompressor()).decompress(payload, n * (4 if wide else 2)), "<u4" if wide else "<u2")


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write the store of all documents to a new path."""
    spark = docs.sparkSession
    arrow(spark)
    docs = texts(docs)
    total = text_bytes(docs)

    def chunked(batches):
        encode, sent, squeeze = file_encoder(tokenizer), set(), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ends, ids = encode(batch["text"])
            n = len(ends) - 1
            all_ids = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(n + 1)
            found = cuts(all_ids, ends)
            per_doc = np.searchsorted(found, ends)
            # 16 bits hold the ids of most vocabularies; a batch with larger ones is stored by 32, marked by a negative n.
            raw, wide = all_ids.astype("<u4").tobytes(), len(all_ids) > 0 and int(all_ids.max()) > 65535
            thin = raw if wide else all_ids.astype("<u2").tobytes()
            width = 4 if wide else 2
            keys, rows = [], []
            for a, b in itertools.pairwise(found.tolist()):
                key = hashlib.blake2b(raw[4 * a : 4 * b], digest_size=KEY_BYTES).digest()
                keys.append(key)
                if key not in sent:
                    if len(sent) > 300_000:
                        sent.clear()
                    sent.add(key)
                    rows.append((key, "chunk", None, a - b if wide else b - a, squeeze(thin[width * a : width * b]), None, None))
            sizes = np.diff(found).astype("<i4")
            for i, doc_id in enumerate(batch["doc_id"].to_pylist()):
                x, y = per_doc[i], per_doc[i + 1]
                root = merkle(keys[x:y])
                rows.append((root[:KEY_BYTES], "recipe", doc_id, int(ends[i + 1] - ends[i]), b"".join(keys[x:y]), sizes[x:y].tobytes(), root))
            yield _objects(rows)

    def once(batches):
        seen = set()
        for batch in batches:
            keep = []
            for key, kind in zip(batch["key"].to_pylist(), batch["kind"].to_pylist()):
                keep.append(kind == "recipe" or key not in seen)
                if kind == "chunk":
                    seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Equal chunks meet where their hash sends them; recipes go by their root plus doc_id, so that equal texts don't pile up.
    made = docs.mapInArrow(chunked, OBJECTS)
    dealt = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("key", "doc_id"))
    made.repartition(parts(spark, total, 32 << 20), dealt).mapInArrow(once, OBJECTS).write.partitionBy("kind").option("compression", "none").parquet(f"{path}/objects")

    recipes = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), F.col("payload").alias("keys"), "sizes", "root")
    ordered = recipes.repartitionByRange(parts(spark, total, 256 << 20), "doc_id").withColumn("file", F.spark_partition_id()).sortWithinPartitions("doc_id", "root")
    ordered.write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.schema("doc_id long, n_tokens long, keys binary, sizes binary, root binary, file int").parquet(f"{path}/ordered")
    # One row for each file: few, whatever the input.
    totals = ordered.groupBy("file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    totals = totals.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1))
    placed = ordered.join(F.broadcast(totals.select("file", F.col("start").alias("base"))), "file")
    placed = placed.withColumn("start", F.col("base") + F.coalesce(before, F.lit(0))).drop("base")
    placed.select("file", "doc_id", "start", "n_tokens", "keys", "sizes", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    totals.join(_roots(spark, path), "file", "left").write.parquet(f"{path}/manifest")


def _objects(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "kind", "doc_id", "n", "payload", "sizes", "root"])


RECIPES = "file int, doc_id long, start long, n_tokens long, keys binary, sizes binary, root binary"


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """The Merkle root of each recipe file, in order of start; documents' roots are computed anew from their chunk hashes."""

    def rooted(batches):
        leaves: dict[int, list] = {}
        for batch in batches:
            for file, keys, root in zip(*(batch[c].to_pylist() for c in ("file", "keys", "root"))):
                found = merkle([keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)])
                if found != root:
                    raise ValueError(f"a recipe of file {file} isn't what was stored")
                leaves.setdefault(file, []).append(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.int32()), pa.array([merkle(x) for x in leaves.values()], pa.binary())], names=["file", "root"])

    n = parts(spark, 0, 1)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("file", "start", "keys", "root")
    return recipes.repartition(n, "file").sortWithinPartitions("file", "start").mapInArrow(rooted, "file int, root binary")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the manifest whose root doesn't follow from the recipes: none, if all is well."""
    manifest = spark.read.schema("file int, n_docs long, n_tokens long, start long, root binary").parquet(f"{path}/manifest")
    return manifest.join(_roots(spark, path).withColumnRenamed("root", "found"), "file", "full").where("found is null or root is null or root <> found")


@functools.cache
def _shift_tables(bits: int) -> np.ndarray:
    """[k, byte, value]: the crc32 register's part after 2 ** k zero bytes, by table lookup."""
    poly = 0xEDB88320  # fixed value: the reflected polynomial of zlib's crc32

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if not vector:
                break
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    one = [poly] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        one = [times(one, row) for row in one]
    tables = np.zeros((bits, 4, 256), np.uint32)
    for k in range(bits):
        for byte in range(4):
            for value in range(256):
                tables[k, byte, value] = times(one, value << (8 * byte))
        one = [times(one, row) for row in one]
    return tables


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The parts that blocks with these crc32s have in the crc32 of what they begin, with so many bytes after each."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    tables = _shift_tables(max(1, int(after.max(initial=0)).bit_length()))
    for k in range(len(tables)):
        on = np.flatnonzero((after >> k) & 1)
        c = crc[on]
        crc[on] = tables[k, 0][c & 255] ^ tables[k, 1][(c >> 8) & 255] ^ tables[k, 2][(c >> 16) & 255] ^ tables[k, 3][c >> 24]
    return crc


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; an error if recipes and manifest disagree."""
    if bad := verify_store(spark, path).select("file").take(10):
        raise ValueError(f"recipes of files {[r['file'] for r in bad]} don't agree with the manifest")
    objects = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 'chunk'").select("key", "n", "payload")

    def checked(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            crcs = []
            for key, n, payload in zip(*(batch[c].to_pylist() for c in ("key", "n", "payload"))):
                raw = _expand(payload, abs(n), n < 0, reader).astype("<u4").tobytes()
                if hashlib.blake2b(raw, digest_size=KEY_BYTES).digest() != key:
                    raise ValueError(f"chunk {key.hex()} isn't what was stored")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(crcs, pa.int64())], names=["key", "crc"])

    def exploded(batches):
        for batch in batches:
            counts = np.array([len(k) // KEY_BYTES for k in batch["keys"].to_pylist()], np.int64)
            sizes = np.frombuffer(b"".join(batch["sizes"].to_pylist()), "<i4").astype(np.int64) * 4
            upto = np.cumsum(sizes)
            last = np.cumsum(counts) - 1
            after = np.repeat(upto[last], counts) - upto
            keys = b"".join(batch["keys"].to_pylist())
            key = pa.array([keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)], pa.binary())
            starts = np.repeat(batch["start"].to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([key, pa.array(starts), pa.array(after)], names=["key", "start", "after"])

    def shifted(batches):
        for batch in batches:
            part = crc_shift(batch["crc"].to_numpy(), batch["after"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["start"], pa.array(part.astype(np.int64))], names=["start", "part"])

    crcs = objects.mapInArrow(checked, "key binary, crc long")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    uses = recipes.select("start", "keys", "sizes").mapInArrow(exploded, "key binary, start long, after long")
    # A chunk that a third of all documents share: its uses are one side of an inner join, which AQE splits.
    parted = uses.join(crcs, "key").mapInArrow(shifted, "start long, part long")
    # start names a document: each has one id at least.
    sums = parted.groupBy("start").agg(F.bit_xor("part").alias("ids_crc32"), F.count("*").alias("found"))
    whole = recipes.select("doc_id", "start", "n_tokens", (F.octet_length("keys") / KEY_BYTES).cast("long").alias("chunks")).join(sums, "start", "left")
    lost = F.coalesce("found", F.lit(0)) != F.col("chunks")
    checked_crc = F.when(lost, F.raise_error(F.concat(F.lit("chunks are missing for document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long")).otherwise(F.col("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", checked_crc.alias("ids_crc32"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each document, put together again from its chunks."""
    objects = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 'chunk'").select("key", "n", "payload")

    def exploded(batches):
        for batch in batches:
            rows = [(start, i, k[i * KEY_BYTES : (i + 1) * KEY_BYTES]) for start, k in zip(batch["start"].to_pylist(), batch["keys"].to_pylist()) for i in range(len(k) // KEY_BYTES)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["start", "i", "key"])

    def joined(pdf):
        pdf = pdf.sort_values("i")
        ids = b"".join(_expand(p, abs(n), n < 0).astype("<u4").tobytes() for p, n in zip(pdf["payload"], pdf["n"]))
        return pdf.head(1).assign(ids=ids)[["doc_id", "start", "ids"]]

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    uses = recipes.select("start", "keys").mapInArrow(exploded, "start long, i int, key binary").join(objects, "key")
    return uses.join(recipes.select("doc_id", "start"), "start").groupBy("start").applyInPandas(joined, "doc_id long, start long, ids binary")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """write_store() into a new folder of the shared folder (or path), then read_store()."""
    path = path or new_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, path, end_id)
    return read_store(docs.sparkSession, path)
