"""Every query that has SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest

import __spark_entry__
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n in SQL])
def test_against_sql(spark, con, name):
    assert differences(__spark_entry__.queries()[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_gives_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
