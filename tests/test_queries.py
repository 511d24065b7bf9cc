"""Every registered reference query against its SQL counterpart on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from patchlake import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR)
    cur = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted((tuple(_plain(dict(zip(columns, r))[c]) for c in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert have == want


def test_no_python_or_nested_loop_in_plans(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    for name in ("diff_file_stats", "diffstat_join", "manifest_rollup", "pii_redact", "gate_references"):
        plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Python" not in plan, name
