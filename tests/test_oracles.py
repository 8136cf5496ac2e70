"""Every query with SQL against DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tickloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


SQL = oracles.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    made = queries.queries()[name](spark, SF)
    columns = sorted(made.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
