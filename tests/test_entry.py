"""The driver's contract, and oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillion.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, views, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = views.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() >= 0
