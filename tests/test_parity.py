"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stemmata import registry


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cell(v):
    return (v is None, str(round(v, 6)) if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, db, data, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    assert name in registry.oracle_sql(), "a query without SQL is compared with nothing"
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(cell(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
