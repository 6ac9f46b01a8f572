"""Every evidence query against its DuckDB twin."""

import pytest

from tracelake import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(name, same):
    same(catalog.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_twin_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    row = catalog.flagship(spark, sf).first()
    assert row.objects > 0 and row.roots == 5
