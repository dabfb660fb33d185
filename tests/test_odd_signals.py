"""Queries on signals equal their SQL where tables hold nulls and what isn't a number, or share keys."""

import duckdb
import pytest

import __spark_entry__ as entry
from tonegrid.plans import catalogue, signals

from .test_queries import rows

EMB, EV = "'/root/testdata/sf0.001/embeddings.parquet'", "'/root/testdata/sf0.01/events.parquet'"


def written(path, embeddings=None, events=None):
    """A connection with these tables as views, and their folder."""
    con = duckdb.connect()
    for t, sql in (("embeddings", embeddings), ("events", events)):
        if sql:
            con.execute(f"COPY ({sql}) TO '{path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con, str(path)


def equal(spark, con, folder, name):
    got, want = rows(entry.queries()[name](spark, folder).toPandas()), rows(con.execute(catalogue.oracle_sql()[name]).df())
    assert want and got == want


@pytest.mark.parametrize("name", ["fp_words_events", "smooth5", "band_energy", "fp_words", "l2_normalise"])
@pytest.mark.parametrize("odd", ["null", "'nan'::DOUBLE"])
def test_samples_that_are_no_numbers(spark, tmp_path, name, odd):
    at = "% 7 = 0" if odd == "null" else "= 250"
    embeddings = f"SELECT * REPLACE (CASE WHEN vec_id {at} THEN list_transform(embedding, lambda x, i: CASE WHEN i % 5 = 0 THEN CAST({odd} AS FLOAT) ELSE x END) ELSE embedding END AS embedding) FROM {EMB}"
    equal(spark, *written(tmp_path, embeddings, f"SELECT * REPLACE (CASE WHEN event_id {at} THEN {odd} ELSE value END AS value) FROM {EV}"), name)


def test_frames_of_nulls_alone_give_no_words(spark, tmp_path):
    equal(spark, *written(tmp_path, events=f"SELECT * REPLACE (CASE WHEN event_id BETWEEN 1000 AND 7000 THEN NULL ELSE value END AS value) FROM {EV}"), "fp_words_events")


#: Copies of a third of the vectors, of 90 of them once more, cut short, and 20 without an id.
SHARED = f"SELECT * FROM {EMB} UNION ALL SELECT * FROM {EMB} WHERE vec_id % 3 = 0 UNION ALL SELECT * REPLACE (embedding[:20] AS embedding) FROM {EMB} WHERE vec_id < 90 UNION ALL SELECT NULL, embedding, label FROM {EMB}, range(20) WHERE vec_id = 7"


@pytest.mark.parametrize("name", ["frames", "smooth5", "band_energy", "fp_words", "l2_normalise", "fingerprint"])
def test_vectors_that_share_an_id(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(signals, "RANGE_ROWS", 200)
    equal(spark, *written(tmp_path, SHARED), name)


def test_null_samples_of_blocks_are_silent(spark, tmp_path):
    equal(spark, *written(tmp_path, f"SELECT * REPLACE (CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i % 5 = 0 THEN NULL ELSE x END) ELSE embedding END AS embedding) FROM {EMB}"), "stream_fp_words")
