"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sluicebox.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def shown(value):
    return "null" if pd.isna(value) else f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, database, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    want = rows(database.sql(registry.ORACLE_SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) <= set(__spark_entry__.queries())
