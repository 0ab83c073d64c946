import pytest

from marktlens.plans import catalog, entries  # noqa: F401
from tests.compare import SF, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert all(len(r) == len(df.columns) for r in df.collect())
