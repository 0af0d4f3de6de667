"""Every registered query runs and has the columns of its oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLES:
        return
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted((tuple(str(same(v)) for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall()))
    got = sorted(tuple(str(same(r[c])) for c in cols) for r in rows)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
