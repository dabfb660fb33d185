"""Exact top-k by inner product through bit-sliced indexes.

Vectors are quantised to integers, dealt into blocks by a hash of their id, and each block becomes an index: one bitmap
over its rows for each bit of each attribute, without the lowest bits. A query adds the slices of all attributes, each weighted by the
bits of its own component, with carry-save bitmap arithmetic; the sums are again bit slices. From the most significant
slice downward they give the k-th largest sum, and then all rows whose sum is within the known rounding error of it. Those boundary
rows are resolved by exact integer products, so the result is exact whatever the rounding.

A block meets the queries in packs, so a task holds one index and one pack; each pair of both gives k rows for each query at most, and
the window over them has a group limit before its shuffle. The index and the answers of blocks are tables in the shared folder.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. Components that
reach 2 ** 24 once quantised are an error, as products might not fit a long. Repeated ids: each row is a candidate; among a query's rows the smallest vector
asks; rows with the query's own id are no candidates. Only vectors of the query's length compare. Ties go to the smaller id, then
repeated rows count one by one. Empty table: no rows. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, stored

ROWS, PACK = 16384, 512
#: Quantised components must be smaller, so that products fit a long.
MOST = 1 << 24
#: Low bits that the slices of attributes and the weights of queries leave out.
SKIP, SKIP_QUERY = 3, 2


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(wide, lambda x: F.floor(x * scale).cast("long"))
    small = F.forall(whole, lambda x: F.abs(x) < MOST)
    too_large = F.raise_error(F.lit(f"a quantised component reaches {MOST}")).cast("array<long>")
    return F.when((F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.when(small, whole).otherwise(too_large))


def add_slices(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps by carry-save adders: levels[w] holds bitmaps (rows of an array) that count 2 ** w each; returns a bitmap per bit."""
    out, carry = [], None
    w = 0
    while w < len(levels) or carry is not None:
        parts = [x for x in ((levels[w] if w < len(levels) else None), carry) if x is not None and len(x)]
        carry, carries = None, []
        if not parts:
            out.append(None)
            w += 1
            continue
        now = np.concatenate(parts) if len(parts) > 1 else parts[0]
        while len(now) > 1:
            third = len(now) // 3
            if third:
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (x & c))
                now = np.concatenate([x ^ c, now[3 * third :]])
            else:  # two are left
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
        out.append(now[0])
        if carries:
            carry = np.concatenate(carries)
        w += 1
    return out


def kth_largest(slices: list[np.ndarray | None], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among the rows of a bitmap (of all, if fewer: the smallest), from the highest slice downward."""
    k = min(k, int(np.bitwise_count(rows).sum()))
    above, equal, value = 0, rows, 0
    for w in range(len(slices) - 1, -1, -1):
        if slices[w] is None:
            continue
        ones = equal & slices[w]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | 1 << w
        else:
            above, equal = above + n, equal & ~slices[w]
    return value


def at_least(slices: list[np.ndarray | None], rows: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows whose value is `least` or more, from the highest slice downward."""
    if least <= 0:
        return rows
    if least >> len(slices):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows
    for w in range(len(slices) - 1, -1, -1):
        bit = slices[w] if slices[w] is not None else np.zeros_like(rows)
        if least >> w & 1:
            equal = equal & bit
        else:
            more = more | (equal & bit)
            equal = equal & ~bit
    return more | equal


class BitSliced:
    """The index of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, skip: int = SKIP):
        self.ids, self.values, self.skip = ids, values, skip
        coarse = values >> skip
        self.least = coarse.min(0)
        shifted = (coarse - self.least).astype(np.uint64)
        self.bits = [max(1, int(m).bit_length()) for m in shifted.max(0)]
        self.words = -(-len(ids) // 64)
        self.slices = [np.stack([self._bitmap((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)]) for d, n in enumerate(self.bits)]
        self.rows = self._bitmap(np.ones(len(ids), np.uint8))

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(bool), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def top(self, query: np.ndarray, own: int, k: int, skip_query: int = SKIP_QUERY) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows for a query, but for rows with the id `own`."""
        rows = self.rows
        mine = np.flatnonzero(self.ids == own)
        if len(mine):
            flags = np.ones(len(self.ids), bool)
            flags[mine] = False
            rows = self._bitmap(flags)
        weight = np.abs(query) >> skip_query
        levels: dict[int, list] = {}
        for d in np.flatnonzero(weight):
            own_slices = self.slices[d] if query[d] > 0 else ~self.slices[d]
            for t in range(int(weight[d]).bit_length()):
                if int(weight[d]) >> t & 1:
                    for b in range(self.bits[d]):
                        levels.setdefault(t + b, []).append(own_slices[b])
        most = max(levels, default=-1) + 1
        sums = add_slices([np.stack(levels[w]) if w in levels else np.zeros((0, self.words), np.uint64) for w in range(most)])
        # What the sums leave out, at most: low bits of the query times all of an attribute, low bits of the attribute times the query.
        span = np.array([(1 << n) - 1 for n in self.bits]) << self.skip
        left = int(((np.abs(query) - (weight << skip_query)) * span).sum() + (np.abs(query) * ((1 << self.skip) - 1)).sum())
        kth = kth_largest(sums, rows, k)
        chosen = at_least(sums, rows, kth - (-(-left >> (self.skip + skip_query)) + 1))
        found = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: len(self.ids)])
        scores = self.values[found] @ query
        order = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][order], scores[order]


def top_k(table: DataFrame, queries: Column, k: int = 10, rows: int = ROWS, pack: int = PACK, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row where `queries` holds."""
    spark = table.sparkSession
    usable = table.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    usable = usable.withColumn("size", F.size("v"))
    shape = usable.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).collect()  # a row for each vector length
    blocks = {r["size"]: max(1, -(-r["n"] // rows)) for r in shape}
    packs = {r["size"]: max(1, -(-r["q"] // pack)) for r in shape}
    schema = "query_id long, vec_id long, score long"
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of = lambda counts: F.coalesce(*(F.when(F.col("size") == s, F.lit(n)) for s, n in counts.items()))
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("id", "v"), of(blocks)).cast("int"))

    def packed(batches):
        """Rows of a block (they come sorted) as one binary row."""
        held: dict = {}
        for batch in batches:
            flat = batch["v"].flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch["size"].to_numpy())])
            for key in sorted(set(zip(batch["size"].to_pylist(), batch["block"].to_pylist()))):
                own = np.flatnonzero((batch["size"].to_numpy() == key[0]) & (batch["block"].to_numpy() == key[1]))
                values = np.stack([flat[ends[i] : ends[i + 1]] for i in own])
                for done in [x for x in held if x != key and x < key]:
                    yield _packed(done, held.pop(done))
                held.setdefault(key, []).append((batch["id"].to_numpy()[own], values))
        for key, rows_ in held.items():
            yield _packed(key, rows_)

    arrow(spark)
    packed_schema = "size int, block int, ids binary, v binary"
    index = stored(dealt.select("id", "v", "size", "block").repartition("size", "block").sortWithinPartitions("size", "block").mapInArrow(packed, packed_schema), "bit-sliced")
    asking = usable.where("asks").groupBy("id", "size").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), of(packs)).cast("int"))
    asked = stored(asking.select("id", "v", "size", "block").repartition("size", "block").sortWithinPartitions("size", "block").mapInArrow(packed, packed_schema), "query-packs")
    # Each pack goes to each block of its length, by an equi-join on block numbers written out.
    every = asked.select("size", F.col("ids").alias("query_ids"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), of(blocks) - 1)).alias("block"))

    def answer(batches):
        last: tuple = (None, None)
        for batch in batches:
            for size, block, ids, v, query_ids, q in zip(*(batch[c].to_pylist() for c in ("size", "block", "ids", "v", "query_ids", "q"))):
                if last[0] != (size, block):
                    last = ((size, block), BitSliced(np.frombuffer(ids, "<i8"), np.frombuffer(v, "<i8").reshape(-1, size)))
                asks, out = np.frombuffer(query_ids, "<i8"), []
                for own, query in zip(asks, np.frombuffer(q, "<i8").reshape(-1, size)):
                    found, scores = last[1].top(query, own, k)
                    out.append((np.full(len(found), own), found, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    arrow(spark, 8)  # a row holds a whole index
    answers = stored(index.join(every, ["size", "block"]).mapInArrow(answer, schema), "top-k")
    arrow(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(key: tuple, rows: list) -> pa.RecordBatch:
    ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([values.astype("<i8").tobytes()])], names=["size", "block", "ids", "v"])
