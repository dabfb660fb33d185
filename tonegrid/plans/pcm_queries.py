"""Sample arithmetic over events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pcm, text
from . import signals

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@_query("SELECT event_id, CAST((event_id % 256 - 128) / 128.0::DOUBLE AS FLOAT) AS sample FROM events")
def pcm8_to_float(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", pcm.from_pcm8(F.col("event_id") % 256).alias("sample"))


@_query("SELECT event_id, CAST(((event_id * 7919) % 65536 - 32768) / 32768.0::DOUBLE AS FLOAT) AS sample FROM events")
def pcm16_to_float(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", pcm.from_pcm16((F.col("event_id") * 7919) % 65536 - 32768).alias("sample"))


@_query(
    "WITH b AS (SELECT event_id, (event_id * 48271) % 16777216 AS u FROM events) "
    "SELECT event_id, CAST((CASE WHEN u >= 8388608 THEN u - 16777216 ELSE u END) / 8388608.0::DOUBLE AS FLOAT) AS sample FROM b"
)
def pcm24_to_float(spark, sf_dir):
    u = (F.col("event_id") * 48271) % (1 << 24)
    return _events(spark, sf_dir).select("event_id", pcm.from_pcm24(u % 256, F.floor(u / 256) % 256, F.floor(u / 65536)).alias("sample"))


@_query("SELECT event_id, CAST(((event_id * 69621) % 4294967296 - 2147483648) / 2147483648.0::DOUBLE AS FLOAT) AS sample FROM events")
def pcm32_to_float(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", pcm.from_pcm32((F.col("event_id") * 69621) % (1 << 32) - (1 << 31)).alias("sample"))


def _quantise_sql(bits: int) -> str:
    scale = 1 << (bits - 1)
    return f"SELECT event_id, CAST(least(greatest(round(CAST(CAST(CAST((value - 256) / 256 AS FLOAT) * CAST({scale} AS FLOAT) AS FLOAT) AS DOUBLE)), -{scale}), {scale - 1}) AS BIGINT) AS code FROM events"


def _quantised(bits: int):
    def run(spark, sf_dir):
        sample = ((F.col("value") - 256) / 256).cast("float")
        return _events(spark, sf_dir).select("event_id", pcm.quantise(sample, bits).alias("code"))

    return run


for _bits in (8, 16, 24):
    _Q[f"quantise_{_bits}"] = _quantised(_bits)
    _SQL[f"quantise_{_bits}"] = _quantise_sql(_bits)


@_query("SELECT event_id, CAST(least(greatest(CAST((value - 256) / 256 AS FLOAT), -1), 1) AS FLOAT) AS sample FROM events")
def clamp(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", pcm.clamp(((F.col("value") - 256) / 256).cast("float")).alias("sample"))


@_query(
    "WITH s AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT vec_id, unnest(range(0, 32)) AS frame, "
    "unnest(list_transform(range(0, 32), lambda i: CAST(CAST(CAST(e[2*i+1] AS FLOAT) + CAST(e[2*i+2] AS FLOAT) AS DOUBLE) / 2 AS FLOAT))) AS value FROM s"
)
def to_mono(spark, sf_dir):
    mono = pcm.to_mono(F.col("samples"), F.lit(2))
    return signals.emb_rows(spark, sf_dir).select("vec_id", F.posexplode(mono).alias("frame", "value")).select("vec_id", F.col("frame").cast("long").alias("frame"), "value")


def _resample_sql(target: int) -> str:
    ratio = f"(8000.0::DOUBLE / {target}.0::DOUBLE)"
    n = int(64 / (8000 / target))
    return f"""
WITH s AS (SELECT vec_id, embedding AS e, unnest(range(0, {n})) AS i FROM embeddings),
     p AS (SELECT vec_id, e, i, i * {ratio} AS spot, CAST(floor(i * {ratio}) AS BIGINT) AS l FROM s),
     q AS (SELECT vec_id, i, CAST(e[l + 1] AS FLOAT) AS a, CAST(e[least(l + 1, 63) + 1] AS FLOAT) AS b, CAST(spot - l AS FLOAT) AS w FROM p)
SELECT vec_id, i AS frame, CAST(a + CAST(CAST(b - a AS FLOAT) * w AS FLOAT) AS FLOAT) AS value FROM q"""


def _resampled(target: int):
    def run(spark, sf_dir):
        made = pcm.resample(F.col("samples"), F.lit(1), F.lit(8000), F.lit(target))
        return signals.emb_rows(spark, sf_dir).select("vec_id", F.posexplode(made).alias("frame", "value")).select("vec_id", F.col("frame").cast("long").alias("frame"), "value")

    return run


for _name, _rate in (("down", 5000), ("up", 11025), ("identity", 8000)):
    _Q[f"resample_{_name}"] = _resampled(_rate)
    _SQL[f"resample_{_name}"] = _resample_sql(_rate)


@_query("SELECT vec_id, unnest(range(0, 64)) % 2 AS channel, unnest(range(0, 64)) // 2 AS frame, CAST(unnest(embedding) AS FLOAT) AS value FROM embeddings")
def deinterleave(spark, sf_dir):
    planes = signals.emb_rows(spark, sf_dir).select("vec_id", F.posexplode(pcm.deinterleave(F.col("samples"), F.lit(2))).alias("channel", "plane"))
    return planes.select("vec_id", F.col("channel").cast("long").alias("channel"), F.posexplode("plane").alias("frame", "value")).withColumn("frame", F.col("frame").cast("long"))


@_query("SELECT vec_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS FLOAT) AS value FROM embeddings")
def interleave(spark, sf_dir):
    again = pcm.interleave(pcm.deinterleave(F.col("samples"), F.lit(4)))
    return signals.emb_rows(spark, sf_dir).select("vec_id", F.posexplode(again).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@_query("SELECT vec_id, CAST(embedding[2 * (vec_id % 40) + 2] AS FLOAT) AS value FROM embeddings")
def sample_at(spark, sf_dir):
    """Past the end there is no sample."""
    return signals.emb_rows(spark, sf_dir).select("vec_id", pcm.sample_at(F.col("samples"), F.lit(2), F.col("vec_id") % 40, F.lit(1)).alias("value"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey > 0 THEN CAST(l_partkey AS DOUBLE) / l_suppkey ELSE 0 END AS seconds, l_partkey * l_linenumber AS n_samples FROM lineitem")
def duration(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seconds = pcm.duration_seconds(F.col("l_partkey"), F.col("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", seconds.alias("seconds"), pcm.sample_count(F.col("l_partkey"), F.col("l_linenumber")).alias("n_samples"))


@_query("SELECT event_id, (event_id * 97 BETWEEN 1 AND 768000) AND (event_id % 70 BETWEEN 1 AND 64) AND event_id >= 5 AS valid, event_id > 0 AND (event_id & (event_id - 1)) = 0 AS power_of_two FROM events")
def is_valid(spark, sf_dir):
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", pcm.is_valid(e * 97, e % 70, e - 5).alias("valid"), pcm.is_power_of_two(e).alias("power_of_two"))


@_query("SELECT n_nationkey, 2 * n_nationkey AS size, 0.0::DOUBLE AS total FROM nation")
def silence(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    zeros = pcm.silence(F.lit(2), F.col("n_nationkey"))
    total = F.aggregate(zeros, F.lit(0.0), lambda s, x: s + x)
    return n.select("n_nationkey", F.size(zeros).alias("size"), total.alias("total"))


_HEADS = {
    "wav": b"RIFF\x24\0\0\0WAVE", "aiff": b"FORM\0\0\0\x24AIFF", "aifc": b"FORM\0\0\0\x24AIFC", "flac": b"fLaC\0\0\0\x22", "ogg": b"OggS\0\2\0\0", "mp4": b"\0\0\0\x18ftypM4A ",
    "id3": b"ID3\4\0\0\0\0\0\0", "mpeg": b"\xff\xfb\x90\x64\0\0", "short": b"RIF", "riff": b"RIFF\x24\0\0\0AVI ", "text": b"hello, world",
}


def _sniff_sql() -> str:
    want = {"wav": "wav", "aiff": "aiff", "aifc": "aiff", "flac": "flac", "ogg": "ogg", "mp4": "mp4", "id3": "mp3", "mpeg": "mp3"}
    rows = ", ".join(f"('{n}', '{want.get(n, 'unknown')}', {str(n in want).lower()})" for n in _HEADS)
    return f"SELECT region.r_regionkey, v.name, v.container, v.decodes FROM region, (VALUES {rows}) AS v(name, container, decodes)"


@_query(_sniff_sql())
def sniff(spark, sf_dir):
    heads = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("content")) for n, b in _HEADS.items()])).alias("h")
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", heads).select("r_regionkey", "h.*")
    kind = pcm.sniff(F.col("content"))
    return r.select("r_regionkey", "name", kind.alias("container"), pcm.decodes(kind).alias("decodes"))


@_query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey >= 2 THEN ['unknown', 'wav', 'aiff', 'flac', 'ogg', 'mp3', 'mp4'][n_nationkey - 1] END, 'unknown') AS name FROM nation")
def container_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", pcm.container_name(F.col("n_nationkey") - 2).alias("name"))


@_query("WITH e AS (SELECT event_id, event_id - 5000 AS x FROM events) SELECT event_id, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS code FROM e")
def zigzag(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", pcm.zigzag(F.col("event_id") - 5000).alias("code"))


@_query(
    "WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || '/' || event_id * 2 WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'no ' || event_id || '/12/9' WHEN 3 THEN event_id || 'b/7' ELSE 'x' END AS t FROM events) "
    "SELECT event_id, CAST(CASE event_id % 5 WHEN 4 THEN 0 ELSE event_id END AS INTEGER) AS number, CAST(CASE event_id % 5 WHEN 0 THEN event_id * 2 WHEN 2 THEN 12 ELSE 0 END AS INTEGER) AS total FROM t"
)
def split_count(spark, sf_dir):
    e = F.col("event_id")
    t = F.when(e % 5 == 0, F.concat(e.cast("string"), F.lit("/"), (e * 2).cast("string"))).when(e % 5 == 1, e.cast("string")).when(e % 5 == 2, F.concat(F.lit("no "), e.cast("string"), F.lit("/12/9"))).when(e % 5 == 3, F.concat(e.cast("string"), F.lit("b/7"))).otherwise("x")
    return _events(spark, sf_dir).select("event_id", text.split_count(t).alias("s")).select("event_id", "s.*")


@_query("SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS key, trim(text, ' ' || chr(0)) AS value FROM documents")
def tag_text(spark, sf_dir):
    """ASCII upper-casing and trimming, as tag fields have them."""
    t = F.col("text")
    padded = F.concat(F.lit("\0 "), t, F.lit(" \0\0"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.upper_ascii(t).alias("key"), text.trimmed(padded).alias("value"))


@_query("SELECT n_nationkey, n_name || chr(233) AS value FROM nation")
def latin1_text(spark, sf_dir):
    body = F.concat(F.encode("n_name", "ISO-8859-1"), F.lit(b"\xe9"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", text.latin1(body).alias("value"))


@_query("SELECT n_nationkey, n_name AS little, n_name AS big FROM nation")
def utf16_text(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", text.utf16(F.encode("n_name", "UTF-16LE"), F.lit(False)).alias("little"), text.utf16(F.encode("n_name", "UTF-16BE"), F.lit(True)).alias("big"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
