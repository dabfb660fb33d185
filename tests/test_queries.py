"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tonegrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return v.item() if isinstance(v, np.generic) else v


def rows(pdf):
    return sorted((tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].to_numpy(dtype=object).tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    want, got = duck.execute(catalogue.oracle_sql()[name]).df(), entry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_all_queries_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and not math.isnan(entry.entry(spark).first()["word"])


def test_comparisons_take_all_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.select("user_id").distinct().count()
    asked = events.where("user_id % 20 = 0").select("user_id").distinct().count()
    assert entry.queries()["popcount"](spark, sf_dir).count() == events.count()
    assert entry.queries()["similarity_join"](spark, sf_dir).count() == asked * (users - 1)
    assert entry.queries()["top_pairs"](spark, sf_dir).count() == 3 * asked
