"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from skerry.plans import catalogue, index
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return tuple(plain(v) for v in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    try:
        return round(float(x), 6) if not isinstance(x, str) and not hasattr(x, "isoformat") else str(x)
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.Q))
def test_query(spark, con, name):
    got = index.queries()[name](spark, SF).toPandas()
    sql = index.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert rows(got) == rows(con.execute(sql).df())
