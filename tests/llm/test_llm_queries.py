"""Registered queries of the subpackage next to their SQL twins."""

import duckdb
import pytest

from check_queries import TABLES, rows
from cuelake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(shipped, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](shipped, sf)
    cur = db.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall()) and sorted(cols) == sorted(df.columns)


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
