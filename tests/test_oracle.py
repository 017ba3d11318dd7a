"""Every registered query against its DuckDB twin (SQL-expressible ones) or
at least a successful run (the others), at sf0.001."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck, spark_pdf
from paths import SF_SMALL

from tabsieve.plans import suite

SQL = suite.ORACLE
NAMES = sorted(suite.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_builder():
    assert set(SQL) <= set(NAMES)
    assert len(NAMES) >= 40


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_oracle(spark, con, name):
    sdf = spark_pdf(E.queries()[name](spark, SF_SMALL))
    ddf = con.execute(SQL[name]).df()
    ok, msg = compare(sdf, ddf)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total"] > 0
