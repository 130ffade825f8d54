import __spark_entry__ as contract
import check_oracles
import pytest

from sitepulse.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
MODEL_DIR = "/root/testdata/sf0.01"  # the smallest tables with a week of every site to learn from


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf_dir = MODEL_DIR if name in catalog.MODEL_QUERIES else SF_DIR
    df = contract.queries()[name](spark, sf_dir)
    assert check_oracles.compare(df, check_oracles.connect(sf_dir), contract.oracle_sql()[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 924 and "rmean_168" in df.columns


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
