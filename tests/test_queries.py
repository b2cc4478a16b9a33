import pytest

import __spark_entry__ as contract
from readloom.plans.catalog import all_queries
from readloom.plans.oracle import all_sql
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(contract.queries()) and set(all_sql()) <= set(contract.oracle_sql())


def test_entry(spark, sf_dir):
    df = contract.entry(spark)
    assert df.columns == ["id", "reference_id", "is_contaminant", "seq_md5"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    verdict, n = oracle.compare(spark, con, name, sf_dir)
    assert verdict == "ok" and n > 0
