"""Removal of repeated runs of lines: a suffix array over line-id sequences, by distributed prefix doubling. DataFrame operations only.

A line's id is a 128-bit hash. The alphabet's order: lines that stand at one place only, in stored order, then the others by their ids.
Suffixes that begin with a line of the other kind are ranked by their first line, then by their first 2, 4, 8, ... lines: the key of a
suffix at depth 2 * h is its rank at depth h with that of the suffix h lines further on. Distinct keys are sorted over ranges, and running
sums of their sizes give ranks: a rank is the place in the suffix array where its group begins, at every depth. Suffixes that are
alone, or that end with their document, are in their final place and are sorted no more; doubling goes on until no other is left, and
documents drop out when all their suffixes are in place. Suffixes that are equal up to the ends of their documents share a rank.

A group at depth h is an interval of the suffix array whose longest common prefix is h lines or more; order() gives for
each suffix the largest such h as `shared`. Removal needs one length only, min_lines: its intervals are formed exactly, by two overlapping
prefixes where min_lines isn't a power of two. The lines that begin at all but the first place (doc_id, then position) of an
interval belong to later copies. Adjacent and overlapping ones form maximal runs, and these are cut out of the text. With
`long_words`, a single line of at least so many words (parted by blanks) is a repeated run too: intervals of depth 1.

Hot groups: keys are counted by partial aggregates. Those that hold a 500th of all open rows or more are at most 500; they are
broadcast, and their rows are dealt by place. All other keys hold less than that, so no task of the join gets a large group.

Lines end at "\\n". Runs without a visible character don't count. Null text: stays null, no lines. Empty text: one empty line.
Null doc_id: untouched, and no source. Repeated rows: equal rows share one place and are changed alike; rows of one doc_id with
different texts are ordered by a hash of the text. Texts that are copies altogether become empty. Empty table: no rows.
Very long texts: a text's lines are ordered in one task, which spills; the text itself is one row.
Other columns stay as they are, whatever their names: the row travels as one struct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored

DOC = ["doc", "hash"]
PLACE = [*DOC, "pos"]
#: Groups with at least a HOT-th of all open rows are broadcast: at most HOT of them.
HOT = 500
#: next_rank of a suffix that ends within the depth. Ranks of lines that stand at one place only lie between it and 0.
ENDED = -(1 << 62)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, hash and text of each row, and the whole row as one struct."""
    return docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("hash"), docs["text"].alias("text"), F.struct(*map(column, docs.columns)).alias("row"))


def _lines(docs: DataFrame, long_words: int | None) -> DataFrame:
    line = F.col("line")
    lines = _keyed(docs).where("doc is not null and text is not null").select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # So many words have a length of their own: only then are they counted.
    long = F.lit(False) if long_words is None else F.when(F.length(line) >= 2 * long_words - 1, F.regexp_count(line, F.lit("[^ \t\r]+")) >= long_words).otherwise(False)
    # Two hashes with different seeds name a line.
    return lines.select(*PLACE, F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"), (F.trim(F.translate(line, "\t\r", "  ")) != "").alias("seen"), long.alias("long"))


def _place():
    return F.struct(*PLACE)


def _with_groups(rows: DataFrame, groups: DataFrame, key: tuple[str, str], n: int) -> DataFrame:
    """rows, with what groups (key, size and others) say of their keys, or nulls. n: how many rows the groups have."""
    told = [c for c in groups.columns if c not in key]
    named = lambda kind: [F.col(c).alias(f"{kind}_{c}") for c in groups.columns]
    hot, cold = F.broadcast(groups.where(F.col("size") >= n / HOT).select(*named("hot"))), groups.where(F.col("size") < n / HOT).select(*named("cold"))
    first, second = key
    found = rows.join(hot, (F.col(first) == F.col(f"hot_{first}")) & (F.col(second) == F.col(f"hot_{second}")), "left")
    # A hot row meets nothing in the second join: it is dealt by its place, and its other key is null.
    known = F.col("hot_size").isNotNull()
    found = found.withColumn("deal", F.when(known, F.xxhash64(*PLACE)).otherwise(F.col(first))).withColumn("also", F.when(~known, F.col(second)))
    found = found.join(cold, (F.col("deal") == F.col(f"cold_{first}")) & (F.col("also") == F.col(f"cold_{second}")), "left")
    return found.select(*rows.columns, *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in told))


def _numbered(groups: DataFrame, key: tuple[str, str]) -> DataFrame:
    """groups (key, size, open, base and others) in order of their keys, with rank (base plus the sizes of all groups before) and with
    the base of the groups they split into. Sums run within ranges; a row for each range goes to all."""
    parted = stored(groups.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "line-groups")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.col("size"), F.when(F.col("open"), F.col("size")).otherwise(0)
    totals = parted.groupBy("part").agg(*(F.sum(c).alias(f"sum{i}") for i, c in enumerate(sizes)))
    totals = totals.select("part", *(F.coalesce(F.sum(f"sum{i}").over(before), F.lit(0)).alias(f"before{i}") for i in range(2)))
    within = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    summed = [F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sizes]
    placed = parted.select("*", *(c.alias(f"own{i}") for i, c in enumerate(summed))).join(F.broadcast(totals), "part")
    rank = F.col("base") + F.col("own0") + F.col("before0")
    kept = [c for c in groups.columns if c != "base"]
    return stored(placed.select(*kept, rank.alias("new"), (rank - F.col("own1") - F.col("before1")).alias("base")), "line-groups")


def _begun(rows: DataFrame, step: int) -> DataFrame:
    """Rows of documents that have open suffixes, with the rank of the suffix `step` lines further on."""
    within = Window.partitionBy(*DOC)
    rows = rows.withColumn("any", F.max("open").over(within)).where("any").drop("any")
    return rows.withColumn("next_rank", F.lead("rank", step, ENDED).over(within.orderBy("pos")))


def _doubled(docs: DataFrame, min_lines: int, long_words: int | None, ordered: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Places (doc, hash, pos from 0, end) where later copies begin; doc, hash and depth of documents with a group at that depth;
    and, if ordered, parts of the suffix array: doc, hash, pos, rank, shared."""
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    if long_words is not None and long_words < 1:
        raise ValueError("long_words must be positive")
    later = F.col("first") != _place()
    lines = _lines(docs, long_words)
    groups = lines.groupBy("a", "b").agg(F.count("*").alias("size"), F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").drop("last")
    groups = _numbered(groups.withColumns({"open": F.lit(True), "base": F.lit(0).cast("long")}), ("a", "b"))
    n = groups.agg(F.sum("size")).first()[0] or 0
    # Depth 1. Equal rows are one place from here on.
    rows = _with_groups(lines, groups, ("a", "b"), n).repartition(*DOC).dropDuplicates(PLACE)
    visible = F.max("seen").over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(0, min_lines - 1))
    single = F.coalesce(later & (F.col("long") | F.lit(min_lines == 1) & F.col("seen")), F.lit(False))
    rank = F.coalesce("new", -1 - F.monotonically_increasing_id())
    left = F.max("pos").over(Window.partitionBy(*DOC)) - F.col("pos") + 1
    rows = rows.select(*PLACE, left.alias("left"), rank.alias("rank"), "base", F.col("size").isNotNull().alias("open"), visible.alias("seen"), single.alias("single"))
    now, depth, columns = stored(_begun(rows, 1), "suffixes"), 1, [*PLACE, "left", "rank", "base", "open", "seen"]
    starts = now.where("single").select(*PLACE, (F.col("pos") + 1).alias("end"))
    depths, order = [], []
    while n := now.where("open").count():
        depths.append(now.where("open").select(*DOC, F.lit(depth).alias("depth")).distinct())
        exact, key = 2 * depth == min_lines, ("rank", "next_rank")
        reaches = lambda rows: rows.where(later & F.col("seen")).select(*PLACE, (F.col("pos") + min_lines).alias("end"))
        if depth < min_lines < 2 * depth:
            over = _begun(now.drop("next_rank"), min_lines - depth).where(f"open and left >= {min_lines}")
            groups = stored(over.groupBy(*key).agg(F.count("*").alias("size"), F.min(_place()).alias("first")), "line-groups")
            starts = starts.union(reaches(_with_groups(over, groups, key, n)))
        tied = now.where("open")
        # A group has suffixes of one kind: with so many lines, or equal to the ends of their documents.
        groups = tied.groupBy(*key).agg(F.count("*").alias("size"), F.max("base").alias("base"), F.min("left").alias("least"), *([F.min(_place()).alias("first")] if exact else []))
        groups = groups.withColumn("open", (F.col("size") > 1) & (F.col("least") >= 2 * depth)).drop("least")
        ranked = _with_groups(tied.drop("base", "open"), _numbered(groups, key), key, n)
        if exact or ordered:
            ranked = stored(ranked, "suffixes")
        if exact:
            starts = starts.union(reaches(ranked.where("open")))
        if ordered:
            order.append(ranked.where("not open").select(*PLACE, F.col("new").alias("rank"), F.lit(depth).alias("shared")))
        rows = ranked.withColumn("rank", F.col("new")).select(*columns).union(now.where("not open").select(*columns)).repartition(*DOC)
        depth *= 2
        now = stored(_begun(rows, depth), "suffixes")
    nothing = now.select(*DOC, F.lit(0).alias("depth"))
    for d in depths:
        nothing = nothing.union(d)
    return starts, nothing.groupBy(*DOC).agg(F.max("depth").alias("longest")), order


def order(docs: DataFrame) -> DataFrame:
    """The suffix array of all suffixes whose first line stands at several places: doc (doc_id), hash (of the text), pos (from 0), rank, and
    shared: the largest power of two of lines that the suffix has in common with another one. Equal ranks: equal to their documents' ends."""
    *_, found = _doubled(docs, 1, None, ordered=True)
    whole = docs.sparkSession.range(0).selectExpr("id as doc", "id as hash", "cast(id as int) as pos", "id as rank", "cast(id as int) as shared")
    for part in found:
        whole = whole.union(part)
    return whole


def later_copies(docs: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """doc, hash, pos (from 0) and end of each place where a run of min_lines lines, or one long line, begins that also begins at an earlier place."""
    return _doubled(docs, min_lines, long_words)[0]


def _runs(starts: DataFrame) -> DataFrame:
    """doc, hash and runs: maximal runs (first, end) of lines to delete, by position, for documents that have any."""
    within = Window.partitionBy(*DOC).orderBy("pos")
    starts = starts.groupBy(*PLACE).agg(F.max("end").alias("end"))
    new = F.coalesce(F.col("pos") > F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = starts.withColumn("run", F.sum(new.cast("int")).over(within)).groupBy(*DOC, "run").agg(F.min("pos").alias("first"), F.max("end").alias("end"))
    return islands.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))


def remove_lines(docs: DataFrame, min_lines: int = 2, counts: bool = False, long_words: int | None = None) -> DataFrame:
    """docs with later copies cut out of text; with counts also n_lines, n_removed, n_runs, and longest_shared: the largest power of
    two of lines in a row that stand at another place, too (0: none)."""
    starts, depths, _ = _doubled(docs, min_lines, long_words)
    found = _runs(starts)
    if counts:
        found = depths.join(found, DOC, "left")  # whatever has runs shares lines
    joined = _keyed(docs).join(found, DOC, "left").withColumn("lines", F.when(F.col("runs").isNotNull() | F.lit(counts), F.split("text", "\n", -1)))
    n, r = F.size("runs"), F.col("runs")
    # What lies between the runs, as slices of the list of lines.
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.try_element_at(r, F.greatest(j, F.lit(1)))["end"])
    stop = lambda j: F.when(j == n, F.size("lines")).otherwise(F.try_element_at(r, F.least(j + 1, n))["first"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda j: F.slice("lines", start(j) + 1, stop(j) - start(j))))
    text = F.when(r.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if counts:
        removed = F.coalesce(F.aggregate(r, F.lit(0), lambda s, x: s + x["end"] - x["first"]), F.lit(0))
        n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
        numbers = {"n_lines": n_lines, "n_removed": removed, "n_runs": F.when(r.isNotNull(), n).otherwise(0), "longest_shared": F.coalesce("longest", F.lit(0))}
        columns += [c.cast("long").alias(name) for name, c in numbers.items()]
    return joined.select(*columns)
