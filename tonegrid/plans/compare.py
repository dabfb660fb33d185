"""Comparing fingerprints: words made of event ids stand for recordings, one for each user, with all of its events. Pairs are compared from
stated lists: each recording with the next, or each query recording (ids divisible by 20) with all others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as sim

#: Recordings whose id is divisible by this one are the queries of a search among all.
QUERY = 20
TOP = 3


def _recordings(spark, sf_dir):
    """Every event: a user's events are a recording, in the order of event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and event_id is not null")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("rec"), pos.alias("pos"), (F.col("event_id") * 2654435761 % (1 << 32)).alias("word"))


def _neighbours(spark, sf_dir):
    """Each recording with the next by number: a stated list of pairs."""
    a = _recordings(spark, sf_dir).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x")).select("rec", F.col("x.word").alias("words"))
    return a.select(F.col("rec").alias("a_id"), F.col("words").alias("a"), (F.col("rec") + 1).alias("b_id")).join(a.select(F.col("rec").alias("b_id"), F.col("words").alias("b")), "b_id")


def popcount(spark, sf_dir):
    return _recordings(spark, sf_dir).select("rec", "pos", F.bit_count("word").cast("int").alias("bits"))


def similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a_id", "b_id", F.round(sim.similarity(F.col("a"), F.col("b")), 12).alias("similarity"))


def offset_similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a_id", "b_id", F.round(sim.offset_similarity(F.col("a"), F.col("b")), 12).alias("similarity"))


def similarity_join(spark, sf_dir, top=None):
    """Each query recording with every other one; with top, those that may be among its most similar."""
    w = _recordings(spark, sf_dir)
    found = sim.similarity_join(w.where(f"rec % {QUERY} = 0"), w, "rec", "rec", others=True, top=top)
    return found.withColumn("similarity", F.round("similarity", 12))


def shift_search(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).select("a_id", "b_id")
    return sim.shift_search(pairs, _recordings(spark, sf_dir), "rec").withColumn("similarity", F.round("similarity", 12))


def top_pairs(spark, sf_dir):
    """Each query recording's three most similar among all others, by similarity, then id."""
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id"))
    return similarity_join(spark, sf_dir, TOP).withColumn("rank", rank).where(f"rank <= {TOP}")


def likely_pairs(spark, sf_dir):
    """All pairs of recordings that share the low nine bits of a word."""
    return sim.likely_pairs(_recordings(spark, sf_dir), "rec", 9)


def queries() -> dict:
    return {f.__name__: f for f in (popcount, similarity, offset_similarity, similarity_join, shift_search, top_pairs, likely_pairs)}


_ROWS_SQL = "r AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (CAST(event_id AS BIGINT) * 2654435761) % 4294967296 AS word FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)"
_VALUE_SQL = "1 - sum(bit_count(xor(a.word, b.word))) / (count(*) * 32.0::DOUBLE)"
_JOIN_SQL = f"SELECT a.rec AS a_id, b.rec AS b_id, round({_VALUE_SQL}, 12) AS similarity FROM r AS a JOIN r AS b ON a.pos = b.pos AND a.rec <> b.rec WHERE a.rec % {QUERY} = 0 GROUP BY a.rec, b.rec"
_SHIFT_SQL = f"""WITH {_ROWS_SQL}, s AS (SELECT unnest(range(-64, 65)) AS s),
e AS (SELECT a.rec AS a_id, b.rec AS b_id, s, {_VALUE_SQL} AS v FROM r AS a JOIN s ON true JOIN r AS b ON b.rec = a.rec + 1 AND b.pos = a.pos + s GROUP BY ALL)
SELECT a_id, b_id, round(max(v), 12) AS similarity FROM e GROUP BY a_id, b_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "popcount": f"WITH {_ROWS_SQL} SELECT rec, CAST(pos AS INTEGER) AS pos, CAST(bit_count(word) AS INTEGER) AS bits FROM r",
        "similarity": f"WITH {_ROWS_SQL} SELECT a.rec AS a_id, b.rec AS b_id, round({_VALUE_SQL}, 12) AS similarity FROM r AS a JOIN r AS b ON b.rec = a.rec + 1 AND a.pos = b.pos GROUP BY a.rec, b.rec",
        "offset_similarity": _SHIFT_SQL,
        "shift_search": _SHIFT_SQL,
        "similarity_join": f"WITH {_ROWS_SQL} {_JOIN_SQL}",
        "top_pairs": f"WITH {_ROWS_SQL}, j AS ({_JOIN_SQL}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS INTEGER) AS rank FROM j) SELECT * FROM k WHERE rank <= {TOP}",
        "likely_pairs": f"WITH {_ROWS_SQL}, k AS (SELECT DISTINCT rec, word % 512 AS key FROM r) SELECT DISTINCT a.rec AS a_id, b.rec AS b_id FROM k AS a JOIN k AS b ON a.key = b.key AND a.rec < b.rec",
    }
