"""Every registered query with an oracle against DuckDB on the same small tables."""

import os

import duckdb
import pytest

from quarry.plans import catalog_queries, result_queries  # noqa: F401  they register theirs
from quarry.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tiny}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tiny, db, name):
    df = QUERIES[name](spark, tiny)
    got = db.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted(([plain(r[i]) for i in order] for r in got.fetchall()), key=str)
    assert sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=str) == want


def test_plans_stay_native(spark, tiny):
    """No Python in the plans of native operators, and filters and columns reach the scan."""
    df = QUERIES["bm25f_topk"](spark, tiny)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    scan = QUERIES["last5_user_turns"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in scan
