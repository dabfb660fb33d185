"""As-of join and what needs it: where the coded frames of MP4 tracks lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str) -> DataFrame:
    """left with the columns of the last row of right, within `by`, whose right_at isn't after left_at (null if there is none).

    Both sides are laid one after the other and the last right row is carried forward, so there is one shuffle on `by` and no range join."""
    values = [c for c in right.columns if c not in by]
    tagged_left = left.withColumns({"__at": F.col(left_at), "__is": F.lit(1), "__right": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    kept = F.struct(*[F.col(c) for c in left.columns if c not in by])
    both = tagged_left.select(*by, "__at", "__is", kept.alias("__left"), "__right")
    other = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__is"), F.lit(None).cast(both.schema["__left"].dataType).alias("__left"), F.struct(*values).alias("__right"))
    order = Window.partitionBy(*by).orderBy("__at", "__is").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other).withColumn("__last", F.last("__right", ignorenulls=True).over(order)).where("__is = 1")
    return joined.select(*by, "__left.*", *[F.col("__last")[c].alias(c) for c in values])


def sample_offsets(tables: DataFrame, key: str) -> DataFrame:
    """key, sample_no (from 0), offset and size of each coded frame, from mp4_tables(): each chunk takes its run as of its
    number, each frame its chunk as of its own number, and offsets are running sums within a chunk."""
    chunks = tables.select(key, F.posexplode("chunks").alias("i", "chunk_offset")).select(key, (F.col("i") + 1).cast("long").alias("chunk_no"), "chunk_offset")
    runs = tables.select(key, F.explode("runs").alias("r")).select(key, "r.*")
    sizes = tables.select(key, F.posexplode("sizes").alias("sample_no", "size")).withColumn("sample_no", F.col("sample_no").cast("long"))
    per = as_of_join(chunks, runs, [key], "chunk_no", "first_chunk")
    before = Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per.withColumn("first_sample", F.coalesce(F.sum("per_chunk").over(before), F.lit(0))).where("per_chunk > 0").select(key, "first_sample", "chunk_no", "chunk_offset", "per_chunk")
    placed = as_of_join(sizes, firsts, [key], "sample_no", "first_sample").where(F.col("sample_no") < F.col("first_sample") + F.col("per_chunk"))
    within = Window.partitionBy(key, "chunk_no").orderBy("sample_no").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.col("chunk_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).select(key, "sample_no", "offset", "size")
