"""Every registered query against its oracle, and the driver's entry point."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from workloads import QUERIES

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NaT or value is pd.NA:
            return (0, "")
        if isinstance(value, float) and value != value:
            return (0, "")
        if isinstance(value, pd.Timestamp):
            return (3, value.isoformat())
        if hasattr(value, "isoformat"):
            return (3, pd.Timestamp(value).isoformat())
        if isinstance(value, bool):
            return (1, str(value))
        if isinstance(value, int | float):
            return (2, repr(float(value)))
        return (4, str(value))

    columns = sorted(frame.columns)
    rows = [tuple(map(plain, row)) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, oracle, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    want = oracle.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    prices = [r.l_extendedprice for r in rows]
    assert len(rows) == 10 and prices == sorted(prices, reverse=True)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql())
