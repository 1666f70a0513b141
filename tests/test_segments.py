"""Walks cut within a feed against the walk from the start; limits pushed below the exchange; frames as one stream, stopped and
started again; candles upserted."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tapeloom import signal_queries  # noqa: F401
from tapeloom.functions.symbols import BASKET
from tapeloom.market_queries import LATENESS, QUERIES
from tapeloom.operators import candles, dedup, segments, sequence
from tapeloom.paths import work_dir
from tapeloom.sources import frames as fr
from tapeloom.sources import sinks, tables
from tapeloom.streaming import jobs, market, stateful
from tests.conftest import DATA

START = 1_725_300_000
TAPE = "feed string, seq long, kind string, symbol string, s double, bid_price double, bid_vol double, ask_price double, ask_vol double"


@pytest.fixture(scope="module")
def tape(spark):
    """One feed and, seldom, another; a gap in its arrivals; a state that is not soon forgotten, and one that is."""
    r, rows = random.Random(4), []
    for k in range(700):
        at = START + 5 * k + r.choice([0, 0, 0, -20, -70, 500 if k == 200 else 0])
        rows.append(("F0" if k % 50 else None, k + (1000 if k > 400 else 0), "quote", r.choice("AB"), float(at - at % 100), float(r.randrange(1, 3)), 1.0, 9.0, 1.0))
    return spark.createDataFrame(rows, TAPE).withColumn("ts", F.timestamp_seconds("s")).cache()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(("capacity", "chunk"), [(1, 40), (8, 40), (60, 25), (500, 100), (3, 100_000)])
def test_dedup_in_stretches(spark, tape, capacity, chunk):
    want = dedup.mark_duplicates_bounded(tape, capacity)
    got = dedup.mark_duplicates_bounded(tape, capacity, chunk=chunk)
    assert rows(got, "feed", "seq", "is_duplicate") == rows(want, "feed", "seq", "is_duplicate")


@pytest.mark.parametrize(("capacity", "lateness", "chunk"), [(4, 60, 40), (30, 600, 25), (1000, 1000, 60), (2, 10, 100_000)])
def test_sequencer_in_stretches(spark, tape, capacity, lateness, chunk):
    want = sequence.sequence_bounded(tape, lateness, capacity)
    got = sequence.sequence_bounded(tape, lateness, capacity, chunk=chunk)
    assert rows(got, "feed", "seq", "outcome", "release_seq") == rows(want, "feed", "seq", "outcome", "release_seq")


def test_one_feed_is_many_tasks(spark, tape, monkeypatch):
    """Short memories settle in one round; a walk that counts from the start takes as many rounds as it needs."""
    seen = []
    real = segments.materialize
    monkeypatch.setattr(segments, "materialize", lambda df: seen.append(df.columns) or real(df))
    out = dedup.mark_duplicates_bounded(tape.where("feed = 'F0'"), 2, chunk=50).cache()
    assert sum("finish" in c and "outcome" in c for c in seen) <= 3 and out.count() == 686

    class Count(segments.Walk):
        def __init__(self, state):
            self.n = int(state or 0)

        def row(self, seq, value):
            self.n += 1
            return [(seq, str(self.n), None)]

        def state(self):
            return str(self.n).encode()

    numbered = segments.walked(tape.where("feed = 'F0'").select("feed", "seq", F.lit(0).cast("long").alias("value")), "feed", 200, Count)
    assert sorted((r.seq, int(r.outcome)) for r in numbered.collect()) == [(s, k) for k, s in enumerate(sorted(r.seq for r in tape.where("feed = 'F0'").collect()), 1)]
    assert segments.walked(tape.limit(0).select("feed", "seq", F.lit(0).cast("long").alias("value")), "feed", 200, Count).count() == 0


def test_history_limits_before_the_exchange(spark):
    plan = QUERIES["candle_history"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    made = spark.createDataFrame([("A", tf, k, k < 9) for tf in ("M1", "D1") for k in range(10)], "symbol string, timeframe string, start_time int, is_closed boolean")
    assert {(r.timeframe, r.start_time) for r in candles.history(made, {"M1": 3, "D1": 1}).collect()} == {("M1", 6), ("M1", 7), ("M1", 8), ("D1", 8)}
    assert {(r.timeframe, r.start_time) for r in candles.kept(made, {"M1": 2, "D1": 1}).collect()} == {("M1", 7), ("M1", 8), ("M1", 9), ("D1", 8), ("D1", 9)}


def test_bars_read_once_are_not_written(spark):
    assert "table-" not in str(QUERIES["indicators_windowed"](spark, DATA).inputFiles())


def test_upserted_candles(spark):
    """Later versions replace earlier ones, other days and partitions stay as they are, and doing it again changes nothing."""
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    make = lambda rows: spark.createDataFrame(rows, "symbol string, timeframe string, s long, close double, is_closed boolean").select(
        "symbol", "timeframe", F.timestamp_seconds("s").alias("start_time"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low")), "close", F.lit(1.0).alias("volume"), F.lit(1).cast("long").alias("first_seq"), "is_closed", F.lit(None).cast("long").alias("closed_by_seq")
    )
    assert sinks.read_candles(spark, path).count() == 0
    sinks.upsert_candles(make([]), path, 0)
    sinks.upsert_candles(make([("A", "M1", 0, 1.0, False), ("A", "M1", 86_400, 2.0, True), ("B", "M15", 0, 3.0, False)]), path, 1)
    two = make([("A", "M1", 0, 4.0, False), ("A", "M1", 0, 5.0, True), ("A", "M1", 60, 6.0, False)])
    for _ in range(2):
        sinks.upsert_candles(two, path, 2)
        got = sorted((r.symbol, r.timeframe, r.start_time.timestamp(), r.close, r.is_closed, r.version) for r in sinks.read_candles(spark, path).collect())
        assert got == [("A", "M1", 0.0, 5.0, True, 2), ("A", "M1", 60.0, 6.0, False, 2), ("A", "M1", 86_400.0, 2.0, True, 1), ("B", "M15", 0.0, 3.0, False, 1)]
    sinks.upsert_candles(make([("A", "M1", 0, 9.0, False)]), path, 1)
    assert {r.close for r in sinks.read_candles(spark, path).where("symbol = 'A' and start_time < '1970-01-01 00:00:30'").collect()} == {5.0}


def test_frames_as_one_stream_stopped_and_started(spark):
    """What the stream leaves after a stop and a batch that failed half-way is what the batch job makes of all frames."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    try:
        path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
        frames = tables.frames(spark, DATA).cache()
        middle = frames.agg(F.percentile_approx("seq", 0.5)).first()[0]
        end = spark.createDataFrame([(None, 1 << 62, None, market.SESSION_END, None)], fr.FRAME_SCHEMA)
        run = lambda: market.run(fr.read_frames(spark, f"{path}/frames", True, 1), path, LATENESS, "M15", list(BASKET))
        jobs.store_in_order(frames.where(F.col("seq") <= middle), f"{path}/frames", 2, form="json")
        half = run()
        assert half.events.count() and half.candles.where("not is_closed").count()
        jobs.store_in_order(frames.where(F.col("seq") > middle).unionByName(end), f"{path}/frames", 2, form="json")
        real, tries = market.upsert_candles, []

        def fails(*args):
            tries.append(args[2])
            if len(tries) == 1:
                raise RuntimeError("lost")
            real(*args)

        market.upsert_candles = fails
        try:
            with pytest.raises(Exception, match="lost"):
                run()
            got = run()
        finally:
            market.upsert_candles = real
        assert tries[0] == tries[1]
        tape = tables.tape(spark, DATA)
        want = sequence.sequence(tape, LATENESS, ("symbol",))
        names = ("symbol", "seq", "kind", "price", "bid_price")
        assert rows(got.events, *names) == rows(want.where("not is_late"), *names) and rows(got.late, *names) == rows(want.where("is_late"), *names)
        converted = tables.converted(spark, DATA)
        assert rows(got.rejects, "seq", "error_kind", "raw") == rows(fr.rejects(converted), "seq", "error_kind", "raw")
        assert rows(got.control, "seq", "msg_type") == rows(fr.control(converted), "seq", "msg_type")
        made = candles.candles(want.where("not is_late and kind = 'trade'"), "M15", mode="event")
        shown = ("symbol", "start_time", "open", "high", "low", "close", "volume")
        assert rows(got.candles, *shown) == rows(made, *shown) and got.candles.where("not is_closed").count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
