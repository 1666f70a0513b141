"""What the plans of queries may hold: the tape is parsed once, and running values don't copy what is below them."""

import pytest

from tapeloom import signal_queries  # noqa: F401  registers its queries
from tapeloom.market_queries import QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize(
    ("name", "scans"),
    [
        ("frame_events", 1), ("reject_summary", 1), ("candles_event_time", 1), ("bounded_sequencer", 1), ("quote_dedup", 2), ("sequencer", 2), ("sequencer_release", 3), ("latest_state", 2), ("candles_arrival", 2), ("candles_all", 2),
        ("candle_history", 2), ("stale_intervals", 2), ("liveness_schedule", 2), ("replay_order", 2), ("job_candles", 3), ("heavy_candles_arrival", 2), ("heavy_candles_event_time", 1), ("indicators_recursive", 1),
    ],
)
def test_scans_and_parsing(spark, name, scans):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= scans and plan.count("from_json") <= 1


def test_running_values_need_one_exchange(spark):
    """However many cuts there are, so that what they carry is no broadcast, rows are exchanged once, and the cuts' small table once."""
    from pyspark.sql import functions as F

    from tapeloom.operators import scan

    rows = spark.range(500).selectExpr("concat('S', id % 3) symbol", "id seq", "id * 7919 % 101 v")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("max", "sum"):
            for before in (False, True):
                cut = scan.running(rows, F.col("v"), "out", "seq", ("symbol",), 40, before, how)
                whole = scan.running(rows, F.col("v"), "out", "seq", ("symbol",), None, before, how)
                assert cut.columns == whole.columns and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
                plan = cut._jdf.queryExecution().sparkPlan().toString(), cut._jdf.queryExecution().executedPlan().toString()
                assert "Join" not in plan[0] and plan[1].split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
