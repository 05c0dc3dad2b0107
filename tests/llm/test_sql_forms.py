"""The corpus queries that SQL can express give the same rows in Spark and DuckDB."""
import pytest

from checks.compare import difference, oracle_connection
from titerflow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, oracle_connection(SF).execute(ORACLE[name]).fetch_df()) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
