import pytest
from oracle import assert_same

from glossaria.queries import QUERIES, SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
