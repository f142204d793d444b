"""Every query with SQL against that SQL on the smallest tables."""

import math

import duckdb
import pytest

from tarsia.queries import ORACLE_SQL, QUERIES, stable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, got):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in got), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        res = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, res.fetchall())


def test_stable():
    assert stable("round(max(a, b), 2)") == "(floor((max(a, b)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)"
