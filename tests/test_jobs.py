"""Every registered job query gives the rows of its SQL."""

import pytest
from oracle import same_rows

from deskmatch import jobs

SQL = jobs.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    same_rows(jobs.queries()[name](spark, small), SQL[name], small)


def test_queries_without_sql_have_rows(spark, small):
    for name in jobs.queries().keys() - SQL.keys():
        assert jobs.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
