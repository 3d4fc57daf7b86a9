"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from hostweave.plans import catalog, oracle
from tools.compare import TABLES, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_but_training_has_sql():
    assert set(catalog.QUERIES) - set(oracle.oracle_sql()) == {"sequence_classifier"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, con.execute(contract.oracle_sql()[name]).df()) == ""
