"""MinHash near-dedup through an inverted join over signature coordinates.

1. Each text becomes its set of word shingles (64-bit hashes) and a signature of COORDINATES minima. Texts with equal sets are one class from
   here on, so a group of copies, however large, is a single row.
2. Classes are posted under each (coordinate, value) pair of a prefix: two classes that agree in THRESHOLD coordinates meet
   under one of the first COORDINATES - THRESHOLD + 1. Postings travel packed, a row for each batch and value range, and are
   merged by value; values posted once are skipped.
3. In each posting list collisions over all coordinates are counted, and the pairs that pass the match threshold are walked from pivots, so
   that a list of n gives a spanning forest of less than n links, not all its pairs. Where pivots take little, the list is posted again: its
   members agree in one coordinate, so those that pass meet under one of COORDINATES - THRESHOLD + 1 others, whichever these are, and the
   ones with the fewest agreements are taken. Spanning links are confirmed on full sets.
4. Crowds (what spanning links connect, confirmed or not) hold every pair that passes. Where confirmed links leave a crowd in
   several parts, members outside its largest part meet all others in blocks of bounded size, with their full sets: a block pair is one
   matrix product, and it gives links between parts only. So no link is lost, and rows grow with members, not with pairs.
5. Components: the smallest doc_id spreads over confirmed links with pointer jumping, in tables of the shared folder.

The match threshold lies so far below the similarity that a pair at exactly 0.8 passes with a chance above 0.999999 (binomial);
confirmation is exact, on the sets of 64-bit shingle hashes. The counting side of a posting carries 16 bits of each coordinate, which never makes
agreements fewer.

Hot classes: links whose class holds a 500th of all links or more are dealt by both ends, and that class' set goes to as many tasks as its
links fill by SPREAD; there are at most 1000 such classes.

Null and empty texts, and texts without words: empty set, linked with nothing, a component each. Texts shorter than a
shingle: the whole sequence is one shingle. Repeated rows: equal sets, so linked; the same doc_id twice gives two rows with equal
values. Null doc_id: left out of links, kept with a null component. Very long texts: one set, in one task. Empty table: no rows. Other columns are
kept by deduplicate() and ignored by classes()."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mix, stored, texts
from .words import pair_hashes, word_hashes

COORDINATES, THRESHOLD = 48, 23
PREFIX = COORDINATES - THRESHOLD + 1
#: Classes that one value range of one coordinate should hold.
RANGE_ROWS = 60_000
SIGNED = "doc_id long, n_shingles long, class binary, signature binary"


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct shingle hashes of each text."""
    ends, hashes = pair_hashes(*word_hashes(column), words)
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])  # lexsort leaves the documents where they were
    return np.concatenate([[0], np.cumsum(keep)])[ends], hashes[keep]


def signatures(ends: np.ndarray, hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minima of so many hash functions over each non-empty set: 32-bit, a row for each text (zeros for empty ones)."""
    out = np.zeros((len(ends) - 1, coordinates), np.uint32)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return out
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    begin = ends[:-1][full]
    step = 1 << 15  # texts are taken by stretches that fit the cache; a long text is a stretch of its own
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + step)))
        lo, hi = begin[at], ends[full[stop - 1] + 1]
        own, cut = hashes[lo:hi], begin[at:stop] - lo
        for c in range(coordinates):
            out[full[at:stop], c] = np.minimum.reduceat(((own * seeds[2 * c] + seeds[2 * c + 1]) >> np.uint64(32)).astype(np.uint32), cut)
        at = stop
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    import hashlib

    def run(batches):
        for batch in batches:
            ends, hashes = shingles(batch["text"], words)
            rows = signatures(ends, hashes)
            raw = hashes.tobytes()
            classes = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:])]
            signs = [r.tobytes() if c else None for r, c in zip(rows, classes)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(ends)), pa.array(classes, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"])

    return docs.mapInArrow(run, SIGNED)


def _passing(counts, size, sizes, similarity: float):
    return (counts >= THRESHOLD) & (np.minimum(size, sizes) >= similarity * np.maximum(size, sizes) - 1e-9)


#: Of lists that are posted again, those up to this size are compared pair by pair, all at once.
FEW = 12


def _few(order: np.ndarray, edges: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the lists of at most so many rows: rows at a distance of 1, 2, ... in the same list."""
    place = np.arange(len(order))
    end = np.repeat(edges + np.where(lengths <= most, lengths, 0), lengths)
    at = [place[place + d < end] for d in range(1, most)]
    return order[np.concatenate(at)], order[np.concatenate([x + d for d, x in enumerate(at, 1)])]


#: Pivots that a list is walked from before it may be posted again, and what that costs a row, in comparisons.
PIVOTS, POSTING = 48, 500


def _agreeing(signs: np.ndarray, pivot: np.ndarray, agreed: int) -> np.ndarray:
    # Agreements as bytes of 0 and 1, added up eight at a time.
    same = signs == pivot
    if same.shape[1] % 8:
        return np.count_nonzero(same, axis=1) + agreed
    return (same.view(np.uint64).sum(1) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64) + agreed


def spanning_links(signs: np.ndarray, sizes: np.ndarray, similarity: float, agreed: int = 0) -> tuple[list, list]:
    """A forest over a list's rows that connects every pair that passes. Each pivot takes what passes with it from the rest, and what it took
    are the next pivots; the first is the row most like the list's commonest values, so lists of one crowd end soon. After PIVOTS of them what
    isn't walked yet is posted again, if that halves the comparisons. agreed: coordinates that all rows agree in, and that signs doesn't have any more."""
    left, right, rest = [], [], np.arange(len(signs))
    if len(signs) > 8:
        commonest = np.sort(signs, 0)[len(signs) // 2]  # a value that most rows have is the middle one, too
        first = int(np.argmax((signs == commonest).sum(1)))
        rest = np.concatenate([[first], rest[rest != first]])
    queue: list[int] = []
    others, walked = np.ascontiguousarray(signs[rest]), 0
    while len(rest):
        if walked == PIVOTS and len(rest) > 4 * POSTING and agreed < THRESHOLD - 1:
            open_ = np.concatenate([np.array(queue, np.int64), rest])
            columns, cost = _best_columns(signs[open_], agreed)
            if 2 * (cost + POSTING * len(open_)) < len(open_) * len(rest) / 2:
                x, y = _posted_again(signs[open_], sizes[open_], similarity, agreed, columns)
                return left + open_[x].tolist(), right + open_[y].tolist()
        walked += 1
        if queue:
            pivot = queue.pop()
        else:
            pivot, rest, others = int(rest[0]), rest[1:], others[1:]
        fit = _passing(_agreeing(others, signs[pivot], agreed), sizes[pivot], sizes[rest], similarity)
        if fit.any():
            found = rest[fit].tolist()
            left += [pivot] * len(found)
            right += found
            queue += found
            rest, others = rest[~fit], others[~fit]
    return left, right


def _best_columns(signs: np.ndarray, agreed: int) -> tuple[np.ndarray, float]:
    """The coordinates under which all rows that pass meet and that tell rows apart best, and the comparisons in their lists."""
    width, pairs = signs.shape[1], []
    for c in range(width):
        ordered = np.sort(signs[:, c])
        lengths = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
        pairs.append(float((lengths.astype(float) ** 2).sum()) / 2)
    columns = np.argsort(pairs, kind="stable")[: width - (THRESHOLD - agreed) + 1]
    return columns, sum(pairs[c] for c in columns)


def _posted_again(signs: np.ndarray, sizes: np.ndarray, similarity: float, agreed: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As spanning_links(), by the lists under these coordinates."""
    width = signs.shape[1]
    root = np.arange(len(signs))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    left, right = [], []
    for c in columns:
        order = np.argsort(signs[:, c], kind="stable")
        values = signs[order, c]
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        lengths = np.diff(np.append(edges, len(order)))
        others = np.delete(np.arange(width), c)
        i, j = _few(order, edges, lengths, FEW)
        fit = _passing(np.count_nonzero(signs[i] == signs[j], axis=1) + agreed, sizes[i], sizes[j], similarity)
        found = list(zip(i[fit].tolist(), j[fit].tolist()))
        for e, n in zip(edges[lengths > FEW], lengths[lengths > FEW]):
            own = order[e : e + n]
            x, y = spanning_links(signs[np.ix_(own, others)], sizes[own], similarity, agreed + 1)
            found += zip(own[x].tolist(), own[y].tolist())
        for a, b in found:  # only what connects more than there is
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def candidates(signed: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links (a < b, class numbers) that connect all pairs that pass the match threshold. signed: number, n_shingles, signature."""
    ranges = max(1, -(-n // RANGE_ROWS))
    width = (1 << 32) // ranges + 1

    def posted(batches):
        for batch in batches:
            if not len(batch):
                continue
            signs = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u4").reshape(-1, COORDINATES)
            small = signs.astype(np.uint16)
            number, sizes = batch["number"].to_numpy(), batch["n_shingles"].to_numpy()
            keys, rows = [], []
            for c in range(PREFIX):
                part = (signs[:, c] * np.uint32(2654435761)) // np.uint32(width) if ranges > 1 else np.zeros(len(signs), np.uint32)  # minima are small: scatter them
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[order], prepend=np.uint32(ranges + 1)))
                for x, y in zip(edges, [*edges[1:], len(order)]):
                    own = order[x:y]
                    keys.append(c * ranges + int(part[own[0]]))
                    rows.append((signs[own, c].tobytes(), number[own].tobytes(), sizes[own].astype("<i4").tobytes(), small[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["key", "at", "number", "size", "signs"])

    def merged(rows: pa.Table) -> pa.Table:
        at, number, sizes, signs = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("at", "<u4"), ("number", "<i8"), ("size", "<i4"), ("signs", "<u2")))
        signs = signs.reshape(-1, COORDINATES)
        order = np.lexsort((number, at))
        ordered = at[order]
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        lengths = np.diff(np.append(edges, len(order)))
        # Lists of two, most by far, all at once; then list by list.
        i, j = _few(order, edges, lengths, 2)
        fit = np.concatenate([_passing(_agreeing(signs[i[a : a + 65536]], signs[j[a : a + 65536]], 0), sizes[i[a : a + 65536]], sizes[j[a : a + 65536]], similarity) for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        left, right = [i[fit]], [j[fit]]
        for e, n_ in zip(edges[lengths > 2], lengths[lengths > 2]):
            own = order[e : e + n_]
            x, y = spanning_links(signs[own], sizes[own], similarity)
            left.append(own[x])
            right.append(own[y])
        a, b = number[np.concatenate(left).astype(np.int64)], number[np.concatenate(right).astype(np.int64)]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    lists = signed.select("number", "n_shingles", "signature").mapInArrow(posted, "key long, at binary, number binary, size binary, signs binary")
    tasks = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), PREFIX * ranges)
    return lists.repartition(tasks, "key").groupBy("key").applyInArrow(merged, "a long, b long").distinct()


#: Bits of the filter of wanted ids, at most: with more ids than these tell apart it lets others through, which the join then drops.
FILTER_BITS = 1 << 26


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of bounded size: 32 bits an id, 8 MB at most."""
    size = min(FILTER_BITS, 1 << max(16, (32 * ids.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = _spots(batch["doc_id"].to_numpy(), size)
            words, each = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, each, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _spots(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id and own (sorted shingle hashes) of the texts whose doc_id stands in wanted. A filter of bounded size drops most
    others where they are read, so that sets are shuffled for the join, never all texts."""
    ids = wanted.select("doc_id").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(_filter(ids))

    def run(batches):
        bits = sent.value
        for batch in batches:
            batch = batch.filter(batch["doc_id"].is_valid())
            at = _spots(batch["doc_id"].to_numpy(zero_copy_only=False), 64 * len(bits))
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            ends, hashes = shingles(batch["text"], words)
            raw = hashes.tobytes()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["doc_id", "own"])

    return docs.mapInArrow(run, "doc_id long, own binary").join(ids, "doc_id", "left_semi")


#: Members of a crowd that a block holds: those outside its largest part, and those in it.
BLOCK_OUTSIDE, BLOCK_INSIDE = 256, 512


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, top: int, columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Places in left and right of the sets that reach the similarity (in hundredths), by products of incidence matrices, some columns at a time."""
    own = np.unique(np.concatenate([left, right]))
    doc = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    _, column, count = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    doc, column = doc[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    x, y = np.searchsorted(own, left), np.searchsorted(own, right)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (at, at + columns))
        grid = np.zeros((len(own), columns), np.float32)
        grid[doc[a:b], column[a:b] - at] = 1
        both += grid[x] @ grid[y].T
    sizes = np.array([len(sets[i]) for i in own], np.float64)
    return np.nonzero(100 * both >= top * (sizes[x][:, None] + sizes[y][None, :] - both))


def across(docs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Confirmed links between the parts of each crowd. members: number, crowd, part."""
    parts_ = members.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    crowds = parts_.groupBy("crowd").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top")).where("parts > 1 and n > 2")
    size = lambda n, each: F.ceil(n / each).cast("int")
    crowds = crowds.select("crowd", F.col("top.part").alias("main"), size(F.col("n") - F.col("top.n"), BLOCK_OUTSIDE).alias("outs"), size(F.col("top.n"), BLOCK_INSIDE).alias("ins"))
    open_ = members.join(crowds, "crowd").withColumn("outside", F.col("part") != F.col("main"))
    own = F.pmod(F.xxhash64("number"), F.when(F.col("outside"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    here = F.col("own_block")
    among = F.transform(upto(F.col("outs")), lambda j: unit(F.least(here, j), F.greatest(here, j), 0))
    towards = F.transform(upto(F.col("ins")), lambda j: unit(here, j, 1))
    units = F.when(F.col("outside"), F.concat(among, towards)).otherwise(F.transform(upto(F.col("outs")), lambda i: unit(i, here, 1)))
    placed = stored(open_.withColumn("own_block", own).withColumn("units", units).select(F.col("number").alias("doc_id"), "crowd", "part", "outside", "own_block", "units"), "crowds")
    rows = placed.join(sets_of(docs, placed, words), "doc_id").select("doc_id", "crowd", "part", "outside", "own_block", "own", F.explode("units").alias("u")).select("doc_id", "crowd", "part", "outside", "own_block", "own", "u.*")
    # Units are dealt by hash, many small ones to a task; each is handled by itself.
    dealt = rows.withColumn("deal", F.xxhash64("crowd", "i", "j", "kind")).repartition("deal").sortWithinPartitions("deal", "crowd", "i", "j", "kind", "doc_id")
    top = round(similarity * 100)

    def link(batches):
        held: list = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("crowd", "i", "j", "kind", "doc_id", "part", "outside", "own_block", "own"))):
                if held and held[0][:4] != row[:4]:
                    yield _links(held, top)
                    held = []
                held.append(row)
        if held:
            yield _links(held, top)

    return dealt.select("crowd", "i", "j", "kind", "doc_id", "part", "outside", "own_block", "own").mapInArrow(link, "a long, b long")


def _links(rows: list, top: int) -> pa.RecordBatch:
    """One link for each two parts of a unit that have any."""
    _, i, j, kind = rows[0][:4]
    sets = [np.frombuffer(r[8], "<u8") for r in rows]
    if kind:
        left = np.array([n for n, r in enumerate(rows) if r[6]], np.int64)
        right = np.array([n for n, r in enumerate(rows) if not r[6]], np.int64)
    else:
        left = np.array([n for n, r in enumerate(rows) if r[7] == i], np.int64)
        right = np.array([n for n, r in enumerate(rows) if r[7] == j], np.int64)
    root = {r[5]: r[5] for r in rows}

    def top_of(x):
        while root[x] != x:
            x = root[x]
        return x

    out: list = []
    if len(left) and len(right):
        for x, y in zip(*similar_pairs(sets, left, right, top)):
            a, b = rows[left[x]], rows[right[y]]
            p, q = top_of(a[5]), top_of(b[5])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(a[4], b[4]), max(a[4], b[4])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b: doc_ids of one text of either class) whose full sets reach the similarity."""
    sides = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    sets = sets_of(docs, sides, words)
    top = round(similarity * 100)

    def check(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch[c].to_pylist() for c in ("a", "x", "y"))):
                if last[0] != a:
                    last = (a, np.frombuffer(x, "<u8"))
                own, other = last[1], np.frombuffer(y, "<u8")
                at = np.searchsorted(own, other)
                both = int((own[np.minimum(at, len(own) - 1)] == other).sum()) if len(own) else 0
                keep.append(100 * both >= top * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    both = _with_set(_with_set(pairs, sets, "b", "y", n), sets, "a", "x", n)
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


#: Links with a hot class that one task should hold.
SPREAD = 256


def _with_set(pairs: DataFrame, sets: DataFrame, end: str, name: str, n: int) -> DataFrame:
    """pairs with the set of the class at this end. A hot class' set is repeated, and its links are dealt over the copies."""
    hot = pairs.groupBy(end).agg(F.count("*").alias("links")).where(F.col("links") >= max(SPREAD, n / 500))
    hot = hot.select(F.col(end).alias("hot"), F.ceil(F.col("links") / SPREAD).cast("int").alias("copies"))
    dealt = pairs.join(F.broadcast(hot), F.col(end) == F.col("hot"), "left")
    dealt = dealt.withColumn("copy", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.col("copies"))).otherwise(0).cast("int")).drop("hot", "copies")
    many = sets.join(F.broadcast(hot), F.col("doc_id") == F.col("hot"), "left")
    many = many.select(F.col("doc_id").alias(end), F.col("own").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    return dealt.join(many, [end, "copy"]).drop("copy")


def components(links: DataFrame) -> DataFrame:
    """number and grp (the smallest number reachable) of every number that stands in links (a, b)."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("number")).agg(F.least(F.min("a"), F.min("b")).alias("grp")), "labels")
    while True:
        # Each takes the smallest label among its neighbours, then jumps to the label of its label.
        near = both.join(labels.select(F.col("number").alias("b"), F.col("grp").alias("near")), "b").groupBy(F.col("a").alias("number")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "number").select("number", F.col("grp").alias("old"), F.least("grp", "near").alias("low"))
        jump = labels.select(F.col("number").alias("low"), F.col("grp").alias("jump"))
        new = stored(lower.join(jump, "low", "left").select("number", "old", F.least("low", F.coalesce("jump", "low")).alias("grp")), "labels")
        labels = new.select("number", "grp")
        if new.where("grp <> old").isEmpty():
            return labels


def classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked, over any number of links) and kept of every row."""
    arrow(docs.sparkSession)
    docs = texts(docs)
    signed = stored(_signed(docs, words), "signatures")
    full = signed.where("class is not null and doc_id is not null")
    # A class goes by its smallest doc_id; rows of one doc_id with different texts are one node of the graph.
    one = stored(full.groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x")).select("class", F.col("x.doc_id").alias("number"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.signature").alias("signature")), "classes")
    spanning = stored(candidates(one, one.count(), similarity), "spanning")
    first = stored(confirmed(spanning, docs, words, similarity).distinct(), "links")
    crowds, groups = components(spanning), components(first)
    members = crowds.select("number", F.col("grp").alias("crowd")).join(groups.select("number", F.col("grp").alias("part")), "number", "left")
    members = stored(members.withColumn("part", F.coalesce("part", "number")), "members")
    final = components(first.union(across(docs, members, words, similarity)))
    by_class = one.select("class", "number").join(final, "number", "left").select("class", F.coalesce("grp", "number").alias("found"))
    whole = signed.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that classes() keeps, with all their columns; rows without a doc_id stay."""
    kept = classes(docs, words, similarity).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long") == kept["__dropped"], "left_anti")
