"""Every query with a SQL twin gives the twin's rows, in DuckDB, on the smallest tables; the others run."""

import datetime
import math
import os

import duckdb
import pytest

from rankflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows_of(rows, columns):
    return sorted(str([plain(row[c]) for c in sorted(columns)]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    if name in SQL:
        twin = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(twin.columns)
        assert rows_of([r.asDict() for r in got], df.columns) == rows_of([dict(zip(twin.columns, r)) for r in twin.fetchall()], twin.columns)
    else:
        assert got
