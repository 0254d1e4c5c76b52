import pytest
from oracle import DATA, compare

from tallyweave.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], DATA) > 0
