import pytest

from radquery.plans import catalogue
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, DATA), duck.sql(catalogue.SQL[name]))


def test_logistic_scorer_covers_the_test_rows(spark):
    assert catalogue.score_logistic(spark, DATA).count() == 75


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
