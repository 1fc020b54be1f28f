"""Every registered query against its SQL restatement in DuckDB (sf0.001), and its plan."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import TABLES, rows_key

SLOW = {"regression", "top_coefficients"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in E.queries() if n not in SLOW])
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert srows and all(len(r) == len(cols) for r in srows)
        return
    res = con.sql(sql)
    assert sorted(res.columns) == cols
    idx = [res.columns.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert rows_key(srows) == rows_key(drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["region", "subset", "pos", "feature_name", "feature_id", "value"]
