"""Registered queries next to their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def test_rates_of_whole_documents_agree(spark, sf):
    """Two ways to the distance of whole documents: bands of the edit table, and characters for words."""
    queries = entry.queries()
    rates = {r.doc_id: r for r in queries["wer"](spark, sf).collect()}
    far = {r.doc_id: r.distance for r in queries["wer_distance"](spark, sf).collect()}
    assert rates.keys() == far.keys() and max(r.ref_words for r in rates.values()) > 1000
    assert all(r.substitutions + r.deletions + r.insertions == far[k] for k, r in rates.items() if r.error is None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
