"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    state, n, _, note = check_oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert state in ("ok", "rows-only"), f"{state}: {note}"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
