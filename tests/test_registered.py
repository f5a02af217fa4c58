"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from logloom.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = canon(map(tuple, df.select(*cols).collect()))
    if name in ORACLE_SQL:
        cur = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})")
        assert got == canon(cur.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
