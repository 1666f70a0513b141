"""Every query of the market-tape operators against its SQL on the smallest tables."""

import pytest

from tapeloom import market_queries, signal_queries, stream_queries  # noqa: F401
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(market_queries.ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(market_queries.QUERIES[name](spark, DATA), duck, market_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(market_queries.QUERIES) - set(market_queries.ORACLES)))
def test_has_rows(spark, name):
    assert market_queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
