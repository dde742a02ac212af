"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
from pathlib import Path

import duckdb
import pytest

from netloom.plans import ORACLE_SQL, QUERIES
from netloom.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{DATA}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return float(value) if type(value).__name__ == "Decimal" else value


def key(row):
    return tuple("" if v is None else f"{v:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


def same(a, b):
    if isinstance(a, float) and b is not None or isinstance(b, float) and a is not None:
        return a == pytest.approx(b, rel=1e-6, abs=1e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(row[c]) for c in columns] for row in df.collect()), key=key)
    if name not in ORACLE_SQL:
        return
    result = db.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(([plain(row[i]) for i in at] for row in result.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)
