"""Every telemetry query against its SQL on the smallest tables, and the driver's contract."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in df.astype(object).itertuples(index=False))


def _names():
    from tracklens.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from tracklens.plans.queries import QUERIES, SQL

    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
