"""Every query with a SQL form gives the same rows in Spark and DuckDB."""
import pytest

import __spark_entry__ as contract
from checks.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, oracle, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert difference(got, oracle.execute(contract.oracle_sql()[name]).fetch_df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
