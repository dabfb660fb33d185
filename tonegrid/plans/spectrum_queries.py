"""Spectra and fingerprints of the embeddings, taken as one recording at the analysis rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectrum as sp
from ..operators import audio
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


def _frames(spark, sf_dir):
    return sp.frames_of_samples(signals.emb_samples(spark, sf_dir))


def _frames_sql(signal: str) -> str:
    return f"""sig AS ({signal}),
f AS (SELECT unnest(range(0, CAST(floor((n - {sp.FRAME}) / {sp.HOP}) AS BIGINT) + 1)) AS frame FROM (SELECT count(*) AS n FROM sig) WHERE n >= {sp.FRAME}),
fr AS (SELECT f.frame, sig.pos - f.frame * {sp.HOP} AS i, sig.value FROM sig JOIN f ON sig.pos BETWEEN f.frame * {sp.HOP} AND f.frame * {sp.HOP} + {sp.FRAME - 1})"""


def _power_sql(signal: str, window: str, low: int, high: int) -> str:
    """Power of bins [low, high) of each frame, by the definition of the transform."""
    shape = {"hann": "0.5 - 0.5", "hamming": "0.54 - 0.46"}[window]
    return f"""{_frames_sql(signal)},
w AS (SELECT frame, i, CAST(value AS DOUBLE) * ({shape} * cos(2 * pi() * i / {sp.FRAME - 1})) AS x FROM fr),
turn AS (SELECT i AS t, cos(2 * pi() * i / {sp.FRAME}) AS c, sin(2 * pi() * i / {sp.FRAME}) AS s FROM range({sp.FRAME}) AS r(i)),
k AS (SELECT unnest(range({low}, {high})) AS bin),
p AS (SELECT frame, bin, sum(x * c) * sum(x * c) + sum(x * s) * sum(x * s) AS power FROM w, k, turn WHERE turn.t = (w.i * k.bin) % {sp.FRAME} GROUP BY frame, bin)"""


_EDGES = [min(e, sp.FRAME // 2) for e in sp.band_edges()]
_BANDS_SQL = f"""{_power_sql(signals.EMB_SQL, 'hann', _EDGES[0], _EDGES[-1])},
e AS (SELECT unnest(range(0, {sp.BANDS})) AS band, unnest({_EDGES[:-1]}) AS a, unnest({_EDGES[1:]}) AS b),
energy AS (SELECT frame, band, sum(power) AS energy FROM p JOIN e ON bin >= a AND bin < b GROUP BY frame, band)"""
_WORDS_SQL = f"""{_BANDS_SQL},
fall AS (SELECT frame, band, energy - lead(energy) OVER (PARTITION BY frame ORDER BY band) AS d FROM energy),
twice AS (SELECT frame, band, d - lag(d) OVER (PARTITION BY band ORDER BY frame) AS dd FROM fall WHERE band < {sp.BANDS - 1})"""


def _window_sql(a: str, b: str) -> str:
    return f"SELECT n_nationkey, unnest(range(0, n_nationkey + 2)) AS i, unnest(list_transform(range(0, n_nationkey + 2), lambda j: round({a} - {b} * cos(2 * pi() * j / (n_nationkey + 1)), 9))) AS w FROM nation"


def _window(column):
    def run(spark, sf_dir):
        n = spark.read.parquet(f"{sf_dir}/nation.parquet")
        return n.select("n_nationkey", F.posexplode(column(F.col("n_nationkey") + 2)).alias("i", "w")).select("n_nationkey", F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))

    return run


_Q["hann"], _SQL["hann"] = _window(sp.hann_column), _window_sql("0.5", "0.5")
_Q["hamming"], _SQL["hamming"] = _window(sp.hamming_column), _window_sql("0.54", "0.46")


@_query(f"WITH {_frames_sql(signals.EMB_SQL)} SELECT CAST(frame AS INTEGER) AS frame, count(*) AS n, min(value) AS low, max(value) AS high, max(value) FILTER (i = 0) AS first FROM fr GROUP BY frame")
def frames(spark, sf_dir):
    made = _frames(spark, sf_dir)
    return made.select("frame", F.size("samples").cast("long").alias("n"), F.array_min("samples").alias("low"), F.array_max("samples").alias("high"), F.element_at("samples", 1).alias("first"))


@_query(
    "WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings), "
    "w AS (SELECT vec_id, i, CAST(v AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM s), k AS (SELECT unnest(range(0, 32)) AS bin) "
    "SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(pow(sum(x * cos(2 * pi() * ((i * bin) % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * ((i * bin) % 64) / 64)), 2), 7) AS power FROM w, k GROUP BY vec_id, bin"
)
def power_spectrum_64(spark, sf_dir):
    power = sp.power_udf("hann")("samples")
    return signals.emb_rows(spark, sf_dir).select("vec_id", F.posexplode(power).alias("bin", "power")).select("vec_id", "bin", F.round("power", 7).alias("power"))


@_query(
    f"SELECT CAST(i AS INTEGER) AS edge, CAST(round({sp.LOW} * pow({sp.HIGH} / {sp.LOW}, i / {sp.BANDS}.0::DOUBLE) * {sp.FRAME} / {sp.RATE}) AS INTEGER) AS bin FROM range({sp.BANDS + 1}) AS r(i)"
)
def band_edges(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(sp.band_edges())), "edge int, bin int")


@_query(
    f"WITH o AS (SELECT bin, ln(bin * {sp.RATE}.0::DOUBLE / {sp.FRAME} / 27.5) / ln(2) AS o FROM range({sp.note_range().start}, {sp.note_range().stop}) AS r(bin)) "
    "SELECT bin, CAST(floor(12 * (o - floor(o))) AS INTEGER) AS note FROM o"
)
def note_of_bin(spark, sf_dir):
    bins = spark.range(sp.note_range().start, sp.note_range().stop).withColumnRenamed("id", "bin")
    return bins.select("bin", sp.note_column(F.col("bin") * float(sp.RATE) / sp.FRAME).alias("note"))


@_query(f"WITH {_BANDS_SQL} SELECT CAST(frame AS INTEGER) AS frame, CAST(band AS INTEGER) AS band, round(energy, 5) AS energy FROM energy")
def band_energy(spark, sf_dir):
    return sp.band_energy_table(_frames(spark, sf_dir)).select("frame", "band", F.round("energy", 5).alias("energy"))


@_query(f"WITH {_WORDS_SQL} SELECT CAST(frame - 1 AS INTEGER) AS pos, CAST(sum(CASE WHEN dd > 0 THEN CAST(1 AS BIGINT) << band ELSE 0 END) AS BIGINT) AS word FROM twice WHERE dd IS NOT NULL GROUP BY frame")
def fp_words(spark, sf_dir):
    """The flagship: band fingerprint words by DataFrame operations over a long table."""
    return sp.band_word_table(sp.band_energy_table(_frames(spark, sf_dir))).select("pos", "word")


@_query(f"WITH {_WORDS_SQL.replace(signals.EMB_SQL, signals.EV_SQL)} SELECT CAST(frame - 1 AS INTEGER) AS pos, CAST(sum(CASE WHEN dd > 0 THEN CAST(1 AS BIGINT) << band ELSE 0 END) AS BIGINT) AS word FROM twice WHERE dd IS NOT NULL GROUP BY frame")
def fp_words_events(spark, sf_dir):
    return sp.band_word_table(sp.band_energy_table(sp.frames_of_samples(signals.ev_samples(spark, sf_dir)))).select("pos", "word")


#: Vectors that make one recording, and a number above its frames: with it a frame's number tells its recording, too.
VECTORS, FRAMES = 480, 1000
_SPAN = 64 * VECTORS


def _files(spark, sf_dir):
    """The signal as recordings of so many vectors each, as WAV files."""
    s = signals.emb_samples(spark, sf_dir).groupBy(F.floor(F.col("pos") / _SPAN).cast("int").alias("recording")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return s.select("recording", audio.encoded(F.col("x.value"), F.lit(sp.RATE), F.lit(1), "wav", 24).alias("content"))


def _many(sql: str) -> str:
    """The same SQL, recording by recording: the signal as it comes back from files of 24 bits, and windows that end with a recording."""
    coded = f"(SELECT pos, CAST(CAST(round(CAST(CAST(value * CAST(8388608 AS FLOAT) AS FLOAT) AS DOUBLE)) AS BIGINT) / 8388608.0::DOUBLE AS FLOAT) AS value FROM ({signals.EMB_SQL}))"
    whole = _frames_sql(signals.EMB_SQL)
    parts = f"""sig AS (SELECT pos // {_SPAN} AS rec, pos % {_SPAN} AS pos, value FROM {coded}),
f AS (SELECT rec, unnest(range(0, CAST(floor((n - {sp.FRAME}) / {sp.HOP}) AS BIGINT) + 1)) AS k FROM (SELECT rec, count(*) AS n FROM sig GROUP BY rec) WHERE n >= {sp.FRAME}),
fr AS (SELECT f.rec * {FRAMES} + f.k AS frame, sig.pos - f.k * {sp.HOP} AS i, sig.value FROM sig JOIN f ON sig.rec = f.rec AND sig.pos BETWEEN f.k * {sp.HOP} AND f.k * {sp.HOP} + {sp.FRAME - 1})"""
    assert whole in sql
    return sql.replace(whole, parts)


_FILE_WORDS = f"SELECT CAST(frame // {FRAMES} AS INTEGER) AS recording, CAST(frame % {FRAMES} - 1 AS INTEGER) AS pos, CAST(sum(CASE WHEN dd > 0 THEN CAST(1 AS BIGINT) << band ELSE 0 END) AS BIGINT) AS word FROM twice WHERE dd IS NOT NULL GROUP BY frame"


@_query(f"""WITH {_many(_WORDS_SQL).replace('PARTITION BY band ORDER BY frame', f'PARTITION BY band, frame // {FRAMES} ORDER BY frame')},
words AS ({_FILE_WORDS}), long AS (SELECT CAST(rec AS INTEGER) AS recording, count(*) / {sp.RATE}.0::DOUBLE AS duration FROM sig GROUP BY rec)
SELECT words.recording, duration, pos, word FROM words JOIN long ON words.recording = long.recording""")
def fingerprint(spark, sf_dir):
    """Files of full length, decoded and fingerprinted."""
    f = audio.fingerprints(_files(spark, sf_dir))
    return f.select("recording", "fingerprint.duration", F.posexplode("fingerprint.words").alias("pos", "word"))


_NOTES = sp.note_range()
_CHROMA_SQL = f"""{_power_sql(signals.EMB_SQL, 'hamming', _NOTES.start, _NOTES.stop)},
o AS (SELECT bin, ln(bin * {sp.RATE}.0::DOUBLE / {sp.FRAME} / 27.5) / ln(2) AS o FROM k),
n AS (SELECT bin, CAST(floor(12 * (o - floor(o))) AS INTEGER) AS note FROM o),
chroma AS (SELECT frame, note, sum(power) AS energy FROM p JOIN n USING (bin) GROUP BY frame, note)"""
_SMOOTH_SQL = f"""{_CHROMA_SQL},
taps AS (SELECT frame - 4 AS row, note, {' + '.join(f'{c} * lag(energy, {4 - i}) OVER w' for i, c in enumerate(sp.SMOOTH))} AS value FROM chroma WINDOW w AS (PARTITION BY note ORDER BY frame)),
smooth AS (SELECT * FROM taps WHERE value IS NOT NULL),
unit AS (SELECT row, note, CASE WHEN sqrt(sum(value * value) OVER (PARTITION BY row)) < {sp.QUIET} THEN 0 ELSE value / sqrt(sum(value * value) OVER (PARTITION BY row)) END AS value FROM smooth)"""


def _classifier_rows() -> str:
    """The classifiers' rectangles as rows: number, sign, rows from and to, classes from and to."""
    rows = []
    for n, (kind, y, h, w, *_) in enumerate(sp.CLASSIFIERS):
        for sign, side in zip((1, -1), sp.rectangles(kind, y, h, w)):
            rows += [f"({n}, {sign}, {a}, {b}, {c}, {d})" for a, b, c, d in side]
    return ", ".join(rows)


_LEVEL_SQL = f"""{_SMOOTH_SQL},
rect AS (SELECT * FROM (VALUES {_classifier_rows()}) AS v(c, sign, a, b, y1, y2)),
limits AS (SELECT * FROM (VALUES {', '.join(f'({n}, {c[4]}::DOUBLE, {c[5]}::DOUBLE, {c[6]}::DOUBLE)' for n, c in enumerate(sp.CLASSIFIERS))}) AS v(c, t0, t1, t2)),
starts AS (SELECT DISTINCT row AS pos FROM unit WHERE row <= (SELECT max(row) FROM unit) - 15),
area AS (SELECT pos, c, coalesce(sum(value) FILTER (sign = 1), 0) AS plus, coalesce(sum(value) FILTER (sign = -1), 0) AS minus
         FROM starts, rect, unit WHERE unit.row >= pos + a AND unit.row < pos + b AND note >= y1 AND note < y2 GROUP BY pos, c),
val AS (SELECT pos, c, ln((1 + plus) / (1 + minus)) AS value FROM area),
lev AS (SELECT pos, c, value, CASE WHEN value < t1 THEN CASE WHEN value < t0 THEN 0 ELSE 1 END ELSE CASE WHEN value < t2 THEN 2 ELSE 3 END END AS level FROM val JOIN limits USING (c))"""


@_query(f"WITH {_CHROMA_SQL} SELECT CAST(frame AS INTEGER) AS frame, note, round(energy, 5) AS energy FROM chroma")
def chroma_energy(spark, sf_dir):
    return sp.chroma_energy_table(_frames(spark, sf_dir)).select("frame", "note", F.round("energy", 5).alias("energy"))


@_query(f"WITH {_SMOOTH_SQL} SELECT CAST(row AS INTEGER) AS row, note, round(value, 5) AS value FROM smooth")
def smooth5(spark, sf_dir):
    return sp.smooth_table(sp.chroma_energy_table(_frames(spark, sf_dir))).select("row", "note", F.round("value", 5).alias("value"))


def _unit(spark, sf_dir):
    return sp.normalise_table(sp.smooth_table(sp.chroma_energy_table(_frames(spark, sf_dir))))


@_query(f"WITH {_SMOOTH_SQL} SELECT CAST(row AS INTEGER) AS row, note, round(value, 9) AS value FROM unit")
def l2_normalise(spark, sf_dir):
    return _unit(spark, sf_dir).select("row", "note", F.round("value", 9).alias("value"))


@_query(f"WITH {_LEVEL_SQL} SELECT CAST(pos AS INTEGER) AS pos, c AS classifier, round(value, 9) AS value, level FROM lev")
def classifier_bits(spark, sf_dir):
    return sp.classifier_table(_unit(spark, sf_dir)).select("pos", "classifier", F.round("value", 9).alias("value"), "level")


@_query(f"WITH {_LEVEL_SQL} SELECT CAST(pos AS INTEGER) AS pos, CAST(sum(CAST([0, 1, 3, 2][level + 1] AS BIGINT) << (2 * (15 - c))) AS BIGINT) AS word FROM lev GROUP BY pos")
def chroma_words(spark, sf_dir):
    return sp.chroma_word_table(sp.classifier_table(_unit(spark, sf_dir))).select("pos", "word")


def _many_levels() -> str:
    sql = _many(_LEVEL_SQL).replace("PARTITION BY note ORDER BY frame", f"PARTITION BY note, frame // {FRAMES} ORDER BY frame")
    every = "SELECT DISTINCT row AS pos FROM unit WHERE row <= (SELECT max(row) FROM unit) - 15"
    assert every in sql
    return sql.replace(every, f"SELECT DISTINCT u.row AS pos FROM unit AS u JOIN (SELECT row // {FRAMES} AS rec, max(row) AS last FROM unit GROUP BY row // {FRAMES}) AS m ON u.row // {FRAMES} = m.rec WHERE u.row <= m.last - 15")


@_query(f"WITH {_many_levels()} SELECT CAST(pos // {FRAMES} AS INTEGER) AS recording, CAST(pos % {FRAMES} AS INTEGER) AS pos, CAST(sum(CAST([0, 1, 3, 2][level + 1] AS BIGINT) << (2 * (15 - c))) AS BIGINT) AS word FROM lev GROUP BY lev.pos")
def chroma_fingerprint(spark, sf_dir):
    """Files of full length, decoded and fingerprinted by pitch."""
    f = audio.fingerprints(_files(spark, sf_dir))
    return f.select("recording", F.posexplode("chroma.words").alias("pos", "word"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
