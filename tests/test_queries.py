"""Every query with SQL gives the SQL's rows; the others run."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from emberline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_the_sql(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs)
    columns = sorted(ours)
    a, b = (x[columns].astype(str).sort_values(columns).values.tolist() for x in (ours, theirs))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_the_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_everything_is_registered():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
