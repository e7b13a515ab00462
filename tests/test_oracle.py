"""Every query of the paper pipeline against its DuckDB oracle on the smallest
tables (those of the training-data operators have their own tests)."""

import pytest

import __spark_entry__ as E
from conftest import SMOKE
from oracle_check import compare, duck
from quire.plans import catalog

catalog.load_all()
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SMOKE)
    assert res["status"] == "match", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "total_count"
    assert len(df.collect()) >= 0
