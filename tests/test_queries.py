from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from rolloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([f"{r[i]:.9g}" if isinstance(r[i], float) else repr(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(got.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
