"""Every registered grid query against its SQL, and the entry point."""

import duckdb
import pytest

from hyperstrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind in "if":
            frame = frame.assign(**{c: frame[c].astype(float) + 0.0})
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
