"""Queries over the shared tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, media, minhash, packing, pfp, secrets, tokenstore, topk, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.remove_repeats(_documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(_documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_documents(spark, sf_dir), words=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_lines(_documents(spark, sf_dir), counts=True, long_words=50)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_shared", F.sha2(F.col("text"), 256).alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
     w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l),
     r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, pos) AS copy FROM w
           WHERE nxt IS NOT NULL AND regexp_matches(line || nxt, '[^ \t\r\n]')),
     s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM l
           WHERE len(regexp_extract_all(line, '[^ \t\r]+')) >= 50),
     g AS (SELECT doc_id, pos FROM r WHERE copy > 1 UNION SELECT doc_id, pos + 1 FROM r WHERE copy > 1 UNION SELECT doc_id, pos FROM s WHERE copy > 1),
     m AS (SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos),
     e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM m),
     p AS (SELECT 1 << k AS n FROM (SELECT unnest(range(0, 30)) AS k)),
     h AS (SELECT d.doc_id, p.n, md5(array_to_string(d.ls[l.pos : l.pos + p.n - 1], chr(10))) AS run FROM d JOIN l ON d.doc_id = l.doc_id JOIN p ON l.pos + p.n - 1 <= len(d.ls)),
     t AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, n, count(*) OVER (PARTITION BY n, run) AS places FROM h) WHERE places > 1 GROUP BY doc_id),
     o AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_runs,
                  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256 FROM e GROUP BY doc_id)
SELECT o.doc_id, n_lines, n_removed, n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_shared, text_sha256 FROM o LEFT JOIN t ON o.doc_id = t.doc_id
UNION ALL SELECT doc_id, 0, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"not ({HELD_OUT})")
    scored = toxicity.score(docs, toxicity.train(docs, labels, "toxic"))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", F.transform("chances", lambda p: F.round(p, 6)).alias("chances"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


OP2_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM c AS q JOIN c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_topk, op3_repeats, op4_media_columns, op5_near_duplicates, op6_line_dedup, op7_toxicity, op8_secret_scan, op9_packing, op10_token_store)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op6_line_dedup": OP6_SQL}
