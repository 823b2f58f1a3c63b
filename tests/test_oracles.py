"""Every registered query with SQL against DuckDB on the small tables."""

import datetime
import decimal

import duckdb
import numpy as np
import pytest

from tallyforge.plans.registry import ORACLES, QUERIES
from tallyforge import catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return ""
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "" if x != x else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
