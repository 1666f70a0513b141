"""Streams against the batch forms on random tapes with late rows, however they are cut into micro-batches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import candles, dedup, latest, liveness, sequence
from tapeloom.paths import work_dir
from tapeloom.streaming import jobs

BASE = 1_725_300_000
SCHEMA = "feed string, seq long, kind string, symbol string, s double, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double"


@pytest.fixture(scope="module")
def tape(spark):
    r, rows = random.Random(8), []
    for k in range(240):
        at = BASE + 7 * k + r.choice([0, 0, -30, -90, 45])
        quote = k % 2 == 0
        sides = (float(r.randrange(1, 4)), 1.0, 9.0, r.choice([0.0, -0.0]))
        rows.append((f"F{k % 2}", k, "quote" if quote else "trade", r.choice("ABC"), float(at - at % 60 if quote else at), None if quote else float(r.randrange(1, 50)), None if quote else float(r.randrange(1, 9)), *(sides if quote else [None] * 4)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    return df.withColumn("recv_ts", F.timestamp_micros((F.col("seq") * 7_000_000 + F.pmod(F.xxhash64("seq"), F.lit(40)) * 1_000_000).cast("long") + BASE * 1_000_000)).drop("s").cache()


def stream(spark, tape, files=5, order="seq"):
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    jobs.store_in_order(tape, path, files, order)
    return jobs.read_tape(spark, path, tape.schema)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


@pytest.mark.parametrize("capacity", [None, 3])
def test_sequencer_and_its_late_table(spark, tape, capacity):
    want = sequence.sequence_bounded(tape, 60, capacity or 10_000, "symbol").where("outcome != 'flush'")
    good, late = jobs.split_late(jobs.sequencer(stream(spark, tape), 60, capacity, "symbol"))
    names = ("symbol", "seq", "outcome", "release_seq")
    got = rows(good.unionByName(late), *names)
    assert got == rows(want, *names)
    outcomes = {r[2] for r in got}
    assert {"ready", "late"} <= outcomes and ("evicted" in outcomes) == (capacity == 3)
    assert {r.outcome for r in late.collect()} == {"late"} and "late" not in {r.outcome for r in good.collect()}


def test_bounded_dedup(spark, tape):
    quotes = tape.where("kind = 'quote'")
    want = rows(dedup.mark_duplicates_bounded(quotes, 2), "feed", "seq", "is_duplicate")
    assert rows(jobs.collect_updates(jobs.bounded_dedup(stream(spark, quotes), 2), "append"), "feed", "seq", "is_duplicate") == want
    assert {r[2] for r in want} == {True, False} and want != rows(dedup.mark_duplicates_bounded(quotes, 2, signed_zero="equal"), "feed", "seq", "is_duplicate")


def test_arrival_candles_and_volume(spark, tape):
    trades = tape.where("kind = 'trade'")
    want = candles.mark_closed(candles.candles(trades, "M1", chunk=11)).withColumn("start_s", F.unix_seconds("start_time"))
    names = ("symbol", "start_s", "open", "high", "low", "close", "volume", "first_seq", "closed_by_seq")
    assert rows(jobs.newest(jobs.collect_updates(jobs.arrival_candles(stream(spark, trades, 7), "M1")), "symbol", "timeframe", "start_s"), *names) == rows(want, *names)
    total = latest.snapshot(latest.mark_stale(trades, 13))
    assert rows(jobs.newest(jobs.collect_updates(jobs.accepted_volume(stream(spark, trades, 3))), "symbol"), "symbol", "total_volume") == rows(total, "symbol", "total_volume")


def test_staleness_timers(spark, tape):
    batch = liveness.stale_intervals(tape, 50.0, 300_000_000)
    want = batch.select("symbol", F.unix_micros("stale_from").alias("stale_from_us"), F.unix_micros("stale_until").alias("stale_until_us"))
    newest = tape.agg(F.max(F.unix_micros("recv_ts"))).first()[0]
    want = want.where(F.col("stale_until_us").isNotNull() | (F.col("stale_from_us") < newest - 1_000_000))
    updates = jobs.collect_updates(jobs.stale_intervals(stream(spark, tape, 9, "recv_ts"), 50.0)).cache()
    names = ("symbol", "stale_from_us", "stale_until_us")
    assert rows(jobs.newest(updates, "symbol", "stale_from_us"), *names) == rows(want, *names)
    assert want.count() > 3


def test_watermark_leaves_late_trades_out(spark, tape):
    """A candle that the watermark has passed stays as it was."""
    at = lambda seq, s, price: ("F", seq, "trade", "A", float(BASE + s), price, 1.0, None, None, None, None)
    parts = [[at(1, 0, 5.0), at(2, 30, 6.0)], [at(3, 600, 7.0)], [at(4, 700, 8.0)], [at(5, 40, 9.0), at(6, 640, 4.0)]]
    df = spark.createDataFrame([r for p in parts for r in p], SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    for low, high in ((1, 2), (3, 3), (4, 4), (5, 6)):
        df.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    got = jobs.newest(jobs.collect_updates(jobs.candles(jobs.read_tape(spark, path, df.schema), "M1", "120 seconds")), "symbol", "timeframe", "start_time")
    assert rows(got.withColumn("s", F.unix_seconds("start_time") - BASE), "s", "low", "high", "volume") == [(0, 5.0, 6.0, 2.0), (600, 4.0, 7.0, 2.0), (660, 8.0, 8.0, 1.0)]


def test_a_repeated_batch_is_written_once(spark, tape):
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    assert jobs.read_batches(spark, path, tape.schema).count() == 0
    for k, part in ((0, "seq < 10"), (1, "seq >= 10"), (1, "seq >= 10")):
        jobs.replace_batch(tape.where(part), k, path)
    assert jobs.read_batches(spark, path, tape.schema).count() == tape.count()
