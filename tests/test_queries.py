"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from tapeloom.plans import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def ordered(rows):
    """Rows of plain values by their texts, then by their numbers to six digits."""
    rows = [tuple(plain(v) for v in r) for r in rows]
    return sorted(rows, key=lambda r: ([v if isinstance(v, str) else "" for v in r], [f"{v:.6g}" if isinstance(v, float) else "" for v in r]))


def alike(a, b):
    """Equal, numbers to a millionth of themselves, or to one in the fourth decimal: both sides may round a half either way."""
    if a == b:
        return True
    if not (isinstance(a, float) and isinstance(b, float)):
        return False
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) or abs(a) > 1 and abs(a - b) < 1.01e-4


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    cur = con.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = ordered(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert len(got) == len(want)
    assert [(x, y) for x, y in zip(got, want) if not all(map(alike, x, y))] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
