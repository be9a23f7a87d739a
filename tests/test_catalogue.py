import pytest
from compare import assert_same

from lumenloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
