"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import pandas as pd
import pytest

from lexspark.plans import queries, queries_retrieval, registry
from lexspark.session import TABLES

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
assert queries and queries_retrieval


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if isinstance(value, (int, float)) else str(value)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, D).count() >= 0
