import pytest
from oracle import connect, same

from tallyspark.plans import catalogue


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, folder, con, name):
    same(catalogue.QUERIES[name](spark, folder), con, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_gives_rows(spark, folder, name):
    assert catalogue.QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["student_id", "billed", "paid", "credit", "status"] and df.count() > 0
