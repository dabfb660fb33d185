"""Documents through five stages: toxicity, line dedup, near-dedup, secret scan, packing.

Each stage gets what its predecessor kept, reread from Parquet, and returns a DataFrame; all but the last return
the columns of documents. A stage's result must be written before the next stage is asked for: the tables it was made from go then.

Nulls: documents without a doc_id pass the filters; null texts count as empty. Very long texts are taken whole by each stage. Repeated rows: the
near-copies stage keeps equal rows of the doc_id that stays. Empty table: no rows. Further columns, whatever their names, are carried by all but the last."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm import common, lines, minhash, packing, queries, secrets, toxicity


#: The tables that the stage asked for last has made.
_made = common.Scratch()


def _stage(f):
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _made.clear()
        with _made:
            return f(spark, docs, sf_dir)

    return run


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, where there is one, follows the text."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*map(common.column, docs.columns))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go. Labels of rows held out by crc32 aren't learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"not ({queries.HELD_OUT})")
    return toxicity.below(docs, toxicity.train(docs, labels, "toxic"), 0.3)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, or of one line of 50 words or more, are cut out of texts; every document stays, an altogether repeated one as an empty text."""
    return _like(lines.remove_lines(docs, long_words=50), docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays: the one with the smallest doc_id."""
    return minhash.deduplicate(docs, words=5, similarity=0.8)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the scan finds is replaced by a sign; every document stays."""
    return _like(secrets.redact(docs, secrets.train(docs)), docs)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document's ids, with its place in a window of 2048."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier decides what stays, so SQL can't give these rows; tests hold each stage against brute force.
ORACLE_SQL = None
