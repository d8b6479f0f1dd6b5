"""Every registered query runs; those with SQL give DuckDB's rows."""

import collections
import decimal
import os

import duckdb
import pytest

from quern.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    other = con.sql(ORACLE_SQL[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    ours = collections.Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    assert ours == collections.Counter(tuple(plain(r[i]) for i in at) for r in other.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
