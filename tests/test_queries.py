"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from vellum.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, str):
        return v
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    return f"{float(v):.9g}"


def rows(df, cols):
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalog.ORACLE_SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
