import __spark_entry__ as entry
import pytest
from hearsay import bindings
from .twins import same


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_matches_sql(spark, data, name):
    same(spark, data, bindings.QUERIES[name], bindings.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLES)))
def test_gives_rows(spark, data, name):
    assert bindings.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "claim_id" and df.count() > 0
    assert set(bindings.QUERIES) <= set(entry.queries()) and set(bindings.ORACLES) <= set(entry.oracle_sql())
