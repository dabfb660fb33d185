"""Comparing fingerprints: words are BIGINT in 0 .. 2 ** 32 - 1."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WORD_BITS = 32


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    """Over the common prefix of two word arrays; 0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: differing_bits(x, y))
    return F.when(n > 0, 1 - F.aggregate(pairs, F.lit(0), lambda s, x: s + x.cast("int")).cast("double") / (n * WORD_BITS)).otherwise(F.lit(0.0))


def offset_similarity(a: Column, b: Column, max_shift: int = 64) -> Column:
    """The best similarity when either begins up to max_shift words later."""
    if max_shift < 0:
        raise ValueError("max_shift must not be negative")
    tail = lambda x, s: F.slice(x, s + 1, F.greatest(F.size(x) - s, F.lit(0)))
    at = lambda s: F.greatest(F.when(s < F.size(a), similarity(tail(a, s), b)).otherwise(0.0), F.when(s < F.size(b), similarity(a, tail(b, s))).otherwise(0.0))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(max_shift)), at))


#: Words that a block of recordings holds, about; positions that are compared at once; the most by which rounding to twelve digits may bring values together.
BLOCK_WORDS, POSITIONS, CLOSE = 1 << 17, 128, 1e-11


def _blocks(rows: DataFrame, recordings: int) -> DataFrame:
    """block, x: rows (id and others) of about so many recordings and at most about BLOCK_WORDS rows, ordered. A recording lies in one block."""
    sizes = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids"))
    blocks = sizes.select(F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_WORDS), F.ceil(F.col("ids") / recordings)).cast("long").alias("blocks"))
    dealt = rows.crossJoin(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    return dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("x"))


def _block_pairs(x: DataFrame, y: DataFrame, on: Column | None = None) -> DataFrame:
    """Every block of x beside every block of y. Neither side is shuffled for it: tasks read the blocks again, a part of one side with a part of the other."""
    side = math.ceil(math.sqrt(16 * x.sparkSession.sparkContext.defaultParallelism))
    x, y = x.coalesce(side), y.coalesce(side)
    return x.hint("shuffle_replicate_nl").crossJoin(y) if on is None else x.hint("shuffle_replicate_nl").join(y, on)


def _numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of ids in order, and the ids by number."""
    d = ids.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _compared(x_rec, x_pos, x_word, nx, y_rec, y_pos, y_word, ny) -> tuple[np.ndarray, np.ndarray]:
    """Common positions and agreeing less differing bits of all recordings of two blocks. Bits are 1 and -1, and 0 where there is no word, so a
    product of matrices has the sums; these are integers that both float types hold."""
    count, score = np.zeros((nx, ny)), np.zeros((nx, ny))
    common = np.intersect1d(x_pos, y_pos)

    def sides(rec, pos, word):
        at = np.searchsorted(common, pos)
        own = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == pos)
        own = own[np.argsort(at[own], kind="stable")]
        return rec[own], at[own], word[own]

    def matrices(rec, col, word, wide):
        ids, row = np.unique(rec, return_inverse=True)
        bits = ((word[:, None] >> np.arange(32)) & 1) * 2 - 1
        once = len(np.unique(row * wide + col)) == len(row)
        kind = np.float32 if once else np.float64
        m, n = np.zeros((len(ids), wide, 32), kind), np.zeros((len(ids), wide), kind)
        if once:
            m[row, col], n[row, col] = bits, 1
        else:
            np.add.at(m, (row, col), bits)
            np.add.at(n, (row, col), 1)
        return ids, m.reshape(len(ids), -1), n

    if not len(common):
        return count, score
    x, y = sides(x_rec, x_pos, x_word), sides(y_rec, y_pos, y_word)
    for low in range(0, len(common), POSITIONS):
        wide = min(POSITIONS, len(common) - low)
        (xi, xm, xn), (yi, ym, yn) = (matrices(s[0][a:b], s[1][a:b] - low, s[2][a:b], wide) for s in (x, y) for a, b in [np.searchsorted(s[1], [low, low + wide])])
        count[np.ix_(xi, yi)] += xn @ yn.T
        score[np.ix_(xi, yi)] += xm @ ym.T
    return count, score


def similarity_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, others: bool = False, top: int | None = None, recordings: int = 1024) -> DataFrame:
    """a_id, b_id, similarity of long tables (id, pos, word): over both lists' common positions. Pairs without any don't appear, nor, with others,
    those of equal ids; rows with a null take no part. Every pair is made in one task, that of its two blocks, so only words are shuffled, never pairs.
    top: only the best so many of each a_id, ties to smaller ids, in each block of b. They are a superset of the best of all, and of those by values
    rounded to twelve digits, for the caller to rank."""
    if recordings < 1 or (top is not None and top < 1):
        raise ValueError("recordings and top must be positive")
    sides = [df.select(F.col(i).alias("id"), F.col("pos").cast("long").alias("pos"), "word").where("id is not null and pos is not null and word is not null") for df, i in ((a, a_id), (b, b_id))]
    x, y = (_blocks(s, recordings).select(*(F.col(f"x.{c}").alias(f"{n}_{c}") for c in ("id", "pos", "word"))) for s, n in zip(sides, "xy"))

    def block(batch, row, name):
        ids, pos, word = (batch.column(f"{name}_{c}")[row].values for c in ("id", "pos", "word"))
        word = word.to_numpy()
        if len(word) and (word.min() < 0 or word.max() >> WORD_BITS):
            raise ValueError("words must be in 0 .. 2 ** 32 - 1")
        rec, ids = _numbered(ids)
        return (rec, pos.to_numpy(), word, len(ids)), ids

    def best(value, i, j):
        """Of pairs ordered by i, j: those that may be among the best of their i. Among equal values the first `top` are enough; beyond the
        value at that rank, those that rounding may bring up to it."""
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        at = np.arange(len(i))
        first = np.r_[True, i[1:] != i[:-1]]
        begin = np.maximum.accumulate(np.where(first, at, 0))
        same = np.maximum.accumulate(np.where(first | np.r_[True, value[1:] != value[:-1]], at, 0))
        last = np.r_[np.flatnonzero(first)[1:], len(i)][np.cumsum(first) - 1]
        limit = value[np.minimum(begin + top, last) - 1] - CLOSE
        keep = (value >= limit) & (at - same < top)
        return i[keep], j[keep], value[keep]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (own, x_ids), (other, y_ids) = block(batch, row, "x"), block(batch, row, "y")
                count, score = _compared(*own, *other)
                if others:
                    at = pc.index_in(x_ids, y_ids)
                    equal = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    count[equal, at.drop_null().to_numpy()] = 0
                step = max(1, (1 << 17) // max(1, len(y_ids)))
                for low in range(0, len(x_ids), step):
                    n, s = count[low : low + step], score[low : low + step]
                    i, j = np.nonzero(n)
                    n, s = n[i, j], s[i, j]
                    value = 1 - (WORD_BITS * n - s) / 2 / (n * WORD_BITS)
                    if top is not None and len(i):
                        i, j, value = best(value, i, j)
                    yield pa.RecordBatch.from_arrays([x_ids.take(pa.array(i + low)), y_ids.take(pa.array(j)), pa.array(value)], names=["a_id", "b_id", "similarity"])

    kinds = [s.schema["id"].dataType for s in sides]
    return _block_pairs(x, y).mapInArrow(run, StructType([StructField("a_id", kinds[0]), StructField("b_id", kinds[1]), StructField("similarity", DoubleType())]))


def shift_search(pairs: DataFrame, words: DataFrame, id_column: str, max_shift: int = 64) -> DataFrame:
    """a_id, b_id, similarity: the best over shifts for listed pairs, from a long table (id, pos, word)."""
    shifts = pairs.withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
    x = words.select(F.col(id_column).alias("a_id"), F.col("pos").alias("a_pos"), F.col("word").alias("x"))
    y = words.select(F.col(id_column).alias("b_id"), F.col("pos").alias("b_pos"), F.col("word").alias("y"))
    joined = shifts.join(x, "a_id").withColumn("b_pos", F.col("a_pos") + F.col("shift")).join(y, ["b_id", "b_pos"])
    each = joined.groupBy("a_id", "b_id", "shift").agg((1 - F.sum(differing_bits(F.col("x"), F.col("y"))) / (F.count("*") * WORD_BITS)).alias("s"))
    return each.groupBy("a_id", "b_id").agg(F.max("s").alias("similarity"))


def _sharing(x_rec, x_key, nx, y_rec, y_key, ny) -> np.ndarray:
    """Which recordings of two blocks share a key: by bitmaps of the common keys, or key by key where that is less."""
    hit = np.zeros((nx, ny), bool)
    common = np.intersect1d(x_key, y_key)
    if not len(common):
        return hit

    def side(rec, key):
        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
        own = common[at] == key
        return rec[own], at[own]

    (xr, xk), (yr, yk) = side(x_rec, x_key), side(y_rec, y_key)
    sizes = np.bincount(yk, minlength=len(common))
    ends = np.cumsum(sizes[xk])
    if ends[-1] * 512 < nx * ny * len(common):  # a hit by key costs about as much as eight words of bitmaps
        yr, starts = yr[np.argsort(yk, kind="stable")], np.cumsum(sizes) - sizes
        cuts = np.searchsorted(ends, np.arange(1 << 21, ends[-1], 1 << 21))
        for own in np.split(np.arange(len(xk)), cuts):
            n = sizes[xk[own]]
            begin = np.cumsum(n) - n
            hit[np.repeat(xr[own], n), yr[np.repeat(starts[xk[own]] - begin, n) + np.arange(n.sum())]] = True
        return hit
    wide = -(-len(common) // 64)
    x, y = np.zeros((wide, nx), np.uint64), np.zeros((wide, ny), np.uint64)
    for bits, r, k in ((x, xr, xk), (y, yr, yk)):
        np.bitwise_or.at(bits, (k >> 6, r), np.uint64(1) << (k & 63).astype(np.uint64))
    for low in range(0, nx, 64):
        part = hit[low : low + 64]
        for own, other in zip(x, y):
            part |= (own[low : low + 64, None] & other) != 0
    return hit


def likely_pairs(words: DataFrame, id_column: str, keep_bits: int = 16, block: int = 2048) -> DataFrame:
    """a_id < b_id of all recordings that share a word's lower bits at any position: candidates for a comparison of all.
    Every such pair is given, and made once: recordings are dealt by their hashes to blocks of about `block`, and a pair belongs to the task
    of its two blocks, so only keys are shuffled, never pairs. The work grows with the square of the recordings, a bit of a bitmap or less for each pair and key."""
    if block < 1:
        raise ValueError("block must be positive")
    keyed = words.select(F.col(id_column).alias("id"), F.col("word").bitwiseAND((1 << keep_bits) - 1).alias("key")).where("id is not null and key is not null").distinct()
    x, y = (_blocks(keyed, block).select(F.col("block").alias(f"{n}_block"), F.col("x.id").alias(f"{n}_id"), F.col("x.key").alias(f"{n}_key")) for n in "xy")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (x_rec, x_ids), (y_rec, y_ids) = (_numbered(batch.column(c)[row].values) for c in ("x_id", "y_id"))
                hit = _sharing(x_rec, batch.column("x_key")[row].values.to_numpy(), len(x_ids), y_rec, batch.column("y_key")[row].values.to_numpy(), len(y_ids))
                if batch.column("x_block")[row] == batch.column("y_block")[row]:
                    hit = np.triu(hit, 1)
                step = max(1, (1 << 17) // max(1, len(y_ids)))
                for low in range(0, len(x_ids), step):
                    i, j = np.nonzero(hit[low : low + step])
                    yield pa.RecordBatch.from_arrays([x_ids.take(pa.array(i + low)), y_ids.take(pa.array(j))], names=["x", "y"])

    kind = keyed.schema["id"].dataType
    pairs = _block_pairs(x, y, F.col("x_block") <= F.col("y_block")).mapInArrow(run, StructType([StructField("x", kind), StructField("y", kind)]))
    return pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
