from __future__ import annotations

import pytest
from oracle import assert_same, connect

from spindrift.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, con, sf_dir, name):
    assert_same(spark, con, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_gives_rows(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
