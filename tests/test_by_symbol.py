"""The tape by symbol: no exchange behind the buckets, and the same rows with hot symbols set apart."""

import pytest
from pyspark.sql import functions as F

from tapeloom import market_queries as mq
from tapeloom.plans import by_symbol, workloads
from tapeloom.sources import tables
from tests.conftest import DATA


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tape(spark):
    """The tape, with one symbol that has about a third of the rows."""
    stored = tables.stored_tape(spark, DATA)
    return stored.withColumn("symbol", F.when(F.col("seq") % 3 == 0, F.lit("HPG")).otherwise(F.col("symbol")))


def test_one_exchange(spark, tape):
    """The exchange that fills the buckets is the only one of dedup, accept window, state, candles and last arrivals."""
    for per_symbol in (False, True):
        kept = by_symbol.store(tape, mq.LATENESS, mq.CHUNK, per_symbol, bucket_rows=100)
        assert kept.hot is None
        for df in (kept.state(), kept.candles(), kept.last_seen(), kept.late()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SelectedBucketsCount" in plan and "out of 1)" not in plan, plan
        kept.drop()


@pytest.mark.parametrize("hot_rows", [10**9, 100, 10])
def test_same_rows(spark, tape, hot_rows):
    """No hot symbol, one, and almost all: what the plain job finds."""
    marked = mq.sequence.sequence(mq.dedup.dedup_quotes(tape), mq.LATENESS)
    events = marked.where("not is_late")
    kept = by_symbol.store(tape, mq.LATENESS, mq.CHUNK, bucket_rows=100, hot_rows=hot_rows)
    assert (kept.hot is None) == (hot_rows == 10**9)
    assert rows(kept.state()) == rows(workloads.market_state(events))
    assert rows(kept.candles()) == rows(workloads.candle_tables(events))
    assert rows(kept.late().select("seq")) == rows(marked.where("is_late").select("seq"))
    watch = mq._watch(spark)
    status, stale = workloads.liveness_tables(events, watch, mq._now(), 36_000.0)
    assert rows(kept.status(watch, mq._now(), 36_000.0).where("status <> 'Untracked'")) == rows(status)
    assert rows(kept.stale_intervals(watch, 36_000.0, mq.DAY)) == rows(stale)
    own = by_symbol.store(tape, mq.LATENESS, mq.CHUNK, True, bucket_rows=100, hot_rows=hot_rows)
    want = mq.sequence.sequence(mq.dedup.dedup_quotes(tape), mq.LATENESS, ("symbol",)).where("is_late")
    assert rows(own.late().select("seq")) == rows(want.select("seq"))


def test_empty(spark, tape):
    kept = by_symbol.store(tape.where("false"), mq.LATENESS, mq.CHUNK)
    assert kept.state().count() == kept.candles().count() == kept.late().count() == 0
