"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from hitgrain.catalog import all_oracles, all_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, SMALL, all_queries()[name], all_oracles()[name]) is None
