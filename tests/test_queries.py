"""Every query against DuckDB on the same tables, where SQL can express it."""

import math
import os

import duckdb
import pytest

from tideline.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    v = float(v)
    return "0" if v == 0 else repr(v) if math.isfinite(v) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    off = [(x, y) for x, y in zip(*[a[1], b[1]], strict=True) if x != y]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_names_are_plain():
    assert all(n.startswith("q_") for n in QUERIES) and os.path.exists("bench.py")
