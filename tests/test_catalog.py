"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

SMALL = Path("/root/testdata/sf0.001")
NAMES = sorted(entry_point.oracle_sql())

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted(names), sorted((tuple(row[n] for n in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    df = entry_point.queries()[name](spark, str(SMALL))
    result = connection.sql(entry_point.oracle_sql()[name])
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(result.columns, result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
