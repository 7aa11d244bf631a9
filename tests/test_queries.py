import pytest
from helpers import DATA, same_rows

from leafmark.plans.oracles import SQL
from leafmark.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001"), SQL[name])


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) == set(SQL)
    assert e.entry(spark).count() == 200
