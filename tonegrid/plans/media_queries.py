"""Files made from the shared tables and read again: what comes back is known in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding, pcm, text
from ..model import NUMBER_TAGS, TEXT_TAGS
from ..operators import asof, audio
from ..sources import mp4, ogg
from ..sources import tags as tagging
from . import signals, spectrum_queries

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- lossless round trips: what comes back is the quantised sample -----------


def _round_trip_sql(bits: int) -> str:
    scale = 1 << (bits - 1)
    return f"""
WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS FLOAT) AS x FROM embeddings),
     q AS (SELECT vec_id, pos, CAST(least(greatest(round(CAST(CAST(x * CAST({scale} AS FLOAT) AS FLOAT) AS DOUBLE)), -{scale}), {scale - 1}) AS BIGINT) AS code FROM s)
SELECT vec_id, 8000 AS sample_rate, {{channels}} AS channels, pos, CAST(code / {scale}.0::DOUBLE AS FLOAT) AS value FROM q"""


def _round_trip(kind: str, bits: int, channels: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = signals.emb_rows(spark, sf_dir)
        coded = rows.select("vec_id", audio.encoded(F.col("samples"), F.col("sample_rate"), F.lit(channels), kind, bits).alias("content"))
        back = coded.select("vec_id", audio.decoded(F.col("content"), mode="failfast").alias("b"))
        return back.select("vec_id", "b.sample_rate", "b.channels", F.posexplode("b.samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))

    return run


for _kind, _depths in {"wav": (16, 24), "flac": (8, 16, 24), "alac": (16, 24), "aiff": (8, 16, 24, 32)}.items():
    for _bits in _depths:
        _name, _channels = f"{_kind}{_bits}_round_trip", 2 if _bits == 16 else 1
        _Q[_name] = _round_trip(_kind, _bits, _channels)
        _SQL[_name] = _round_trip_sql(_bits).format(channels=_channels)


def _files(spark: SparkSession, sf_dir: str, kind: str, bits: int = 16) -> DataFrame:
    rows = signals.emb_rows(spark, sf_dir)
    return rows.select("vec_id", "samples", audio.encoded(F.col("samples"), F.col("sample_rate"), F.lit(2), kind, bits).alias("content"))


def _little(content, at: int, n: int):
    """A little-endian number in a binary column."""
    parts = [F.conv(F.hex(F.substring(content, at + i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(n)]
    return sum(parts[1:], parts[0])


@_query("SELECT vec_id, 1::BIGINT AS encoding, 2::BIGINT AS channels, 8000::BIGINT AS rate, 32000::BIGINT AS byte_rate, 4::BIGINT AS block, 16::BIGINT AS bits, 128::BIGINT AS data_bytes, 172::BIGINT AS file_bytes FROM embeddings")
def wav_header_fields(spark, sf_dir):
    c = F.col("content")
    fields = {"encoding": (20, 2), "channels": (22, 2), "rate": (24, 4), "byte_rate": (28, 4), "block": (32, 2), "bits": (34, 2), "data_bytes": (40, 4)}
    return _files(spark, sf_dir, "wav").select("vec_id", *[_little(c, a, n).alias(k) for k, (a, n) in fields.items()], F.octet_length(c).cast("long").alias("file_bytes"))


def _probe_sql() -> str:
    kinds = {"wav": "pcm", "aiff": "pcm", "flac": "flac", "alac": "alac"}
    names = {"alac": "mp4"}
    return " UNION ALL ".join(f"SELECT vec_id, '{names.get(k, k)}' AS container, '{c}' AS codec, 8000 AS sample_rate, 2 AS channels, CAST(32 AS BIGINT) AS frames, true AS frames_known, {str(x).lower()} AS exact FROM embeddings" for x in (False, True) for k, c in kinds.items())


@_query(_probe_sql())
def probe(spark, sf_dir):
    """Header probes and exact ones, of four containers."""
    out = None
    for exact in (False, True):
        for kind in ("wav", "aiff", "flac", "alac"):
            p = _files(spark, sf_dir, kind).select("vec_id", audio.probed(F.col("content"), exact, "failfast").alias("p"), F.lit(exact).alias("exact")).select("vec_id", "p.container", "p.codec", "p.sample_rate", "p.channels", "p.frames", "p.frames_known", "exact")
            out = p if out is None else out.unionByName(p)
    return out


@_query("SELECT vec_id, true AS same FROM embeddings")
def flac_md5(spark, sf_dir):
    """The signature in STREAMINFO is that of the quantised samples."""
    codes = F.transform("samples", lambda x: pcm.quantise(x, 16))
    plain = F.unhex(F.array_join(F.transform(codes, lambda c: F.concat(F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0"), F.lpad(F.hex(F.pmod(F.floor(c / 256), F.lit(256))), 2, "0"))), ""))
    return _files(spark, sf_dir, "flac").select("vec_id", (F.lower(F.hex(F.substring("content", 27, 16))) == F.md5(plain)).alias("same"))


_CODES_SQL = "c AS (SELECT vec_id, i, CAST(round(CAST(CAST(CAST(x AS FLOAT) * CAST(32768 AS FLOAT) AS FLOAT) AS DOUBLE)) AS BIGINT) AS c FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings))"


def _difference_sql(order: int) -> str:
    sql, last = f"WITH {_CODES_SQL}", "c"
    for n in range(order):
        sql += f", d{n} AS (SELECT vec_id, i, c - lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM {last} WHERE c IS NOT NULL)"
        last = f"d{n}"
    return f"{sql} SELECT vec_id, i - {order} AS pos, c AS residual FROM {last} WHERE c IS NOT NULL"


def _codes(spark, sf_dir):
    return signals.emb_rows(spark, sf_dir).select("vec_id", F.transform("samples", lambda x: pcm.quantise(x, 16)).alias("codes"))


def _difference(order: int):
    def run(spark, sf_dir):
        rows = _codes(spark, sf_dir).select("vec_id", F.posexplode(coding.difference(F.col("codes"), order)).alias("pos", "residual"))
        return rows.withColumn("pos", F.col("pos").cast("long"))

    return run


for _order in range(5):
    _Q[f"fixed_residual_{_order}"], _SQL[f"fixed_residual_{_order}"] = _difference(_order), _difference_sql(_order)


@_query(f"WITH {_CODES_SQL} SELECT vec_id, i AS pos, c AS code FROM c")
def fixed_restore(spark, sf_dir):
    rows = _codes(spark, sf_dir)
    again = coding.restore(F.element_at("codes", 1), coding.difference(F.col("codes"), 1))
    return rows.select("vec_id", F.posexplode(again).alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))


@_query(
    f"WITH {_CODES_SQL}, d AS (SELECT vec_id, c - lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS r FROM c), z AS (SELECT vec_id, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS z FROM d WHERE r IS NOT NULL), "
    "k AS (SELECT unnest(range(0, 15)) AS k), b AS (SELECT vec_id, k, CAST(sum((z >> k) + 1 + k) + 4 AS BIGINT) AS bits FROM z, k GROUP BY vec_id, k) "
    "SELECT vec_id, min(bits) AS bits, CAST(arg_min(k, bits * 100 + k) AS INTEGER) AS k FROM b GROUP BY vec_id"
)
def rice_best_k(spark, sf_dir):
    return _codes(spark, sf_dir).select("vec_id", coding.best_parameter(coding.difference(F.col("codes"), 1)).alias("b")).select("vec_id", "b.bits", "b.k")


@_query("SELECT vec_id, CAST(NULL AS INTEGER) AS sample_rate, 3 AS status FROM embeddings")
def decode_errors(spark, sf_dir):
    """Files cut short are errors, as values."""
    cut = _files(spark, sf_dir, "wav").select("vec_id", audio.decoded(F.expr("substring(content, 1, octet_length(content) - 1)")).alias("b"))
    return cut.select("vec_id", "b.sample_rate", "b.error.status")


# --- containers --------------------------------------------------------------


def _documents(spark, sf_dir):
    """Null texts and labels count as empty."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _made(df: DataFrame, f) -> DataFrame:
    """doc_id and content: a file made of each whole text."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [f(row) for row in pdf.itertuples()]})

    return df.mapInPandas(run, "doc_id long, content binary")


_LINES_SQL = "l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@_query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(7 AS BIGINT) AS serial, CAST(n AS INTEGER) AS packet_no, CAST(strlen(line) AS BIGINT) AS n_bytes, md5(line) AS digest FROM l")
def ogg_packets(spark, sf_dir):
    """Every line of a text is a packet; pages hold few segments, so that packets go on over pages."""
    made = _made(_documents(spark, sf_dir), lambda row: ogg.write_stream([x.encode() for x in row.text.split("\n")], serial=7, per_page=5))
    return audio.ogg_packets(made, "doc_id").select("doc_id", "serial", "packet_no", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


def _track(row) -> bytes:
    frames = [x.encode() for x in row.text.split("\n")]
    return mp4.write_track(b"alac", b"", 8000, 1, 16, frames, 64, 64 * len(frames), per_chunk=3)


@_query(f"WITH {_LINES_SQL} SELECT doc_id, n AS sample_no, CAST(strlen(line) AS BIGINT) AS size, md5(line) AS digest FROM l")
def mp4_asof_samples(spark, sf_dir):
    """Every line of a text is a coded frame: its place follows from the sample tables by as-of joins."""
    made = _made(_documents(spark, sf_dir), _track)
    places = asof.sample_offsets(audio.mp4_tables(made, "doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("sample_no", "offset", "size")).alias("samples"))
    # A file's own samples are cut where it is: files are joined once each, not once for each sample.
    cut = F.transform("samples", lambda x: F.struct(x["sample_no"].alias("sample_no"), x["size"].alias("size"), F.md5(F.substring(F.col("content"), (x["offset"] + 1).cast("int"), x["size"].cast("int"))).alias("digest")))
    return places.join(made, "doc_id").select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.sample_no", "x.size", "x.digest")


@_query("SELECT doc_id, unnest(['/ftyp', '/moov', '/moov/mvhd', '/moov/trak', '/moov/trak/tkhd', '/moov/trak/mdia', '/moov/trak/mdia/mdhd', '/moov/trak/mdia/hdlr', '/moov/trak/mdia/minf', '/moov/trak/mdia/minf/smhd', '/moov/trak/mdia/minf/dinf', '/moov/trak/mdia/minf/dinf/dref', '/moov/trak/mdia/minf/stbl', '/moov/trak/mdia/minf/stbl/stsd', '/moov/trak/mdia/minf/stbl/stts', '/moov/trak/mdia/minf/stbl/stsc', '/moov/trak/mdia/minf/stbl/stsz', '/moov/trak/mdia/minf/stbl/stco', '/mdat']) AS path FROM documents")
def mp4_boxes(spark, sf_dir):
    return audio.mp4_boxes(_made(_documents(spark, sf_dir), _track), "doc_id").select("doc_id", "path")


@_query("SELECT e.event_id, c.event_id AS last_id, c.value AS last_value FROM events AS e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') AS c ON e.user_id = c.user_id AND e.event_id >= c.event_id")
def as_of(spark, sf_dir):
    """Each event with its user's last click up to then."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return asof.as_of_join(e.select("user_id", "event_id"), clicks, ["user_id"], "event_id", "last_id").select("event_id", "last_id", "last_value")


# --- tags --------------------------------------------------------------------

_FIELDS = ("title", "artist", "album", "date", "comment", "trackNumber", "trackTotal")


def _tagged(made: DataFrame, *fields: str) -> DataFrame:
    return made.select("doc_id", audio.tags(F.col("content")).alias("t")).select("doc_id", *[F.col(f"t.{f}") for f in fields or _FIELDS])


@_query("SELECT doc_id, source AS title, lang AS artist, 'doc ' || doc_id AS album, CAST(1900 + doc_id % 100 AS VARCHAR) AS date, source || lang AS comment, CAST(doc_id % 99 + 1 AS INTEGER) AS \"trackNumber\", 0 AS \"trackTotal\" FROM documents")
def id3v1(spark, sf_dir):
    return _tagged(_made(_documents(spark, sf_dir), lambda r: b"\xff\xfb\x90\x64" + bytes(60) + tagging.write_id3v1(r.source, r.lang, f"doc {r.doc_id}", str(1900 + r.doc_id % 100), r.source + r.lang, r.doc_id % 99 + 1, 255)))


_TRIM = "trim(text, ' ' || chr(0))"


def _id3v2(version: int, encoding: int):
    names = {2: ("TT2", "TP1", "TAL", "TYE", "COM", "TRK")}.get(version, ("TIT2", "TPE1", "TALB", "TDRC" if version == 4 else "TYER", "COMM", "TRCK"))

    def run(spark, sf_dir):
        made = _made(_documents(spark, sf_dir), lambda r: tagging.write_id3v2(list(zip(names, (r.text, r.lang, r.source, "2026", r.text, f"{r.doc_id % 99 + 1}/99"))), version, encoding))
        return _tagged(made)

    return run


for _version, _encoding in ((2, 1), (3, 1), (3, 2), (4, 3)):
    _Q[f"id3v2_{_version}_{_encoding}"] = _id3v2(_version, _encoding)
    _SQL[f"id3v2_{_version}_{_encoding}"] = f"SELECT doc_id, {_TRIM} AS title, lang AS artist, source AS album, '2026' AS date, {_TRIM} AS comment, CAST(doc_id % 99 + 1 AS INTEGER) AS \"trackNumber\", 99 AS \"trackTotal\" FROM documents"

_COMMENT_SQL = "SELECT doc_id, text AS title, lang AS artist, source AS album, CAST(doc_id AS VARCHAR) AS date, '' AS comment, CAST(doc_id % 99 + 1 AS INTEGER) AS \"trackNumber\", 99 AS \"trackTotal\" FROM documents"


def _comments(r) -> list:
    return [("Title", r.text), ("artist", r.lang), ("ALBUM", r.source), ("DATE", str(r.doc_id)), ("TrackNumber", f"{r.doc_id % 99 + 1}"), ("TOTALTRACKS", "99")]


@_query(_COMMENT_SQL)
def flac_comment(spark, sf_dir):
    return _tagged(_made(_documents(spark, sf_dir), lambda r: tagging.write_flac_tags(_comments(r))))


@_query(_COMMENT_SQL)
def ogg_comment(spark, sf_dir):
    head = b"\x01vorbis" + bytes(23)
    return _tagged(_made(_documents(spark, sf_dir), lambda r: ogg.write_stream([head, b"\x03vorbis" + tagging.write_vorbis_comment(_comments(r)) + b"\1"])))


@_query(_COMMENT_SQL.replace("text AS title", f"{_TRIM} AS title"))
def mp4_tags(spark, sf_dir):
    return _tagged(_made(_documents(spark, sf_dir), lambda r: tagging.write_mp4_tags([(b"\xa9nam", r.text.encode()), (b"\xa9ART", r.lang.encode()), (b"\xa9alb", r.source.encode()), (b"\xa9day", str(r.doc_id).encode()), (b"trkn", bytes([0, 0, 0, r.doc_id % 99 + 1, 0, 99, 0, 0]))])))


@_query("SELECT doc_id, text AS title, lang AS artist, 0 AS \"trackNumber\", source AS mood, length(text) = 0 AS empty FROM documents")
def tags_json(spark, sf_dir):
    made = _made(_documents(spark, sf_dir), lambda r: tagging.write_flac_tags([("TITLE", r.text), ("ARTIST", r.lang), ("MOOD", r.source)]))
    t = made.select("doc_id", audio.tags(F.col("content")).alias("t"))
    read = t.select("doc_id", text.tags_json(F.col("t")).alias("j"), text.tags_are_empty(F.col("t")).alias("empty"))
    field = lambda path: F.get_json_object("j", path)
    return read.select("doc_id", field("$.title").alias("title"), field("$.artist").alias("artist"), field("$.trackNumber").cast("int").alias("trackNumber"), field("$.other[0].value").alias("mood"), "empty")


@_query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS genre, CAST(CASE WHEN doc_id % 5 = 0 THEN 7 ELSE doc_id % 5 END AS INTEGER) AS \"trackNumber\", "
    "CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'a' END AS keys FROM documents"
)
def tags_merge(spark, sf_dir):
    """A newer tag, filled up from an older one; genre is never filled, keys already there aren't added."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))

    def tag(**given):
        fields = [given.get(n, F.lit("")).alias(n) for n in TEXT_TAGS] + [given.get(n, F.lit(0)).cast("int").alias(n) for n in NUMBER_TAGS]
        return F.struct(*fields, given["other"].alias("other"))

    d = F.col("doc_id")
    newer = tag(title=F.when(d % 2 == 0, F.col("text")).otherwise(""), genre=F.when(d % 3 == 0, "").otherwise(F.col("lang")), trackNumber=d % 5, other=F.array(entry("a", F.col("lang"))))
    older = tag(title=F.col("source"), genre=F.lit("old"), trackNumber=F.lit(7), other=F.when(d % 2 == 0, F.array(entry("a", F.lit("x")), entry("b", F.lit("y")))).otherwise(F.array(entry("a", F.lit("x")))))
    return _documents(spark, sf_dir).select("doc_id", text.merge_tags(newer, older).alias("t")).select("doc_id", "t.title", "t.genre", "t.trackNumber", F.array_join("t.other.key", ",").alias("keys"))


# --- streaming ---------------------------------------------------------------


@_query(spectrum_queries.oracle_sql()["fp_words"].replace("CAST(frame - 1 AS INTEGER) AS pos", "frame - 1 AS pos"))
def stream_fp_words(spark, sf_dir):
    """Words from a stream of blocks, which don't line up with frames."""
    from ..streaming import audio as stream

    path = signals.shared_path(spark, "stream")
    samples = signals.emb_samples(spark, sf_dir)
    blocks = samples.groupBy(F.col("recording_id").cast("long").alias("recording_id"), F.floor(F.col("pos") / 1000).alias("block_no")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    blocks.select("recording_id", "block_no", F.col("x.value").alias("samples")).write.parquet(f"{path}/blocks")
    source = spark.readStream.schema("recording_id long, block_no long, samples array<float>").option("maxFilesPerTrigger", 2).parquet(f"{path}/blocks")
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/words/batch={n}")
    q = stream.fingerprint_stream(source).writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("recording_id long, pos long, word long").parquet(f"{path}/words/batch=*").select("pos", "word")


@_query("SELECT vec_id, 64 / 8000.0::DOUBLE AS duration, 0 AS n_words, 0 AS n_chroma FROM embeddings")
def fingerprint_files(spark, sf_dir):
    """Recordings too short for a word have none."""
    found = audio.fingerprints(_files(spark, sf_dir, "wav").select("vec_id", "content"))
    return found.select("vec_id", (F.col("fingerprint.duration") * 2).alias("duration"), F.size("fingerprint.words").alias("n_words"), F.size("chroma.words").alias("n_chroma"))


@_query("SELECT vec_id, unnest(range(0, 32)) AS pos, CAST(unnest(list_transform(range(0, 32), lambda i: CAST(CAST(q[2*i+1] AS FLOAT) + CAST(q[2*i+2] AS FLOAT) AS DOUBLE) / 2)) AS FLOAT) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(CAST(CAST(x AS FLOAT) * CAST(32768 AS FLOAT) AS FLOAT) AS DOUBLE)) / 32768) AS q FROM embeddings)")
def decode_mono(spark, sf_dir):
    back = _files(spark, sf_dir, "flac").select("vec_id", audio.decoded(F.col("content"), mono=True, mode="failfast").alias("b"))
    return back.select("vec_id", F.posexplode("b.samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
