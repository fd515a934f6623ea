"""Queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tiny, name):
    db = duckdb.connect()
    for f in os.listdir(tiny):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tiny}/{f}'")
    df = QUERIES[name](spark, tiny)
    got = db.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == want
