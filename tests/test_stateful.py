"""Streams over the RocksDB state store against the batch forms and plain loops, cut, stopped and started again."""

import datetime as dt
import random
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import dedup, sequence, signals
from tapeloom.paths import work_dir
from tapeloom.streaming import jobs, stateful

START = 1_725_300_000
TAPE = "feed string, seq long, kind string, symbol string, s double, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double"
BARS = "symbol string, start_time timestamp, low double, high double, is_valid boolean, passes boolean, score double, stop_loss double, take_profit double, arrival long"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


@pytest.fixture(scope="module")
def tape(spark):
    r, rows = random.Random(18), []
    for k in range(300):
        at = START + 7 * k + r.choice([0, 0, -30, -90, 45])
        quote = k % 2 == 0
        rows.append((f"F{k % 2}", k, "quote" if quote else "trade", r.choice("ABC"), float(at - at % 60 if quote else at), None if quote else float(r.randrange(1, 50)), None if quote else float(r.randrange(1, 9)), *((float(r.randrange(1, 4)), 1.0, 9.0, r.choice([0.0, -0.0])) if quote else [None] * 4)))
    return spark.createDataFrame(rows, TAPE).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s").cache()


@pytest.fixture(scope="module")
def bars(spark):
    """Two symbols' bars that come a little out of order; B has no valid bar for a while, and some scores are missing."""
    r, rows = random.Random(5), []
    for symbol in "ABC":
        price = 100.0
        for k in range(70):
            price *= 1 + r.choice([-0.03, -0.01, 0.0, 0.01, 0.04])
            at = dt.datetime(2024, 9, 2, tzinfo=dt.UTC) + dt.timedelta(minutes=15 * k)
            rows.append((symbol, at, price * 0.99, price * 1.01, r.random() > 0.1, r.random() > 0.3, r.choice([None, 0.5, 0.8, 0.9]), price * 0.97, price * 1.05, 3 * k + "ABC".index(symbol) + r.choice([0, 0, 4, -4])))
    return spark.createDataFrame(rows, BARS).cache()


def stored(spark, df, files, order="seq", path=None):
    path = path or f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    jobs.store_in_order(df, path, files, order)
    return jobs.read_tape(spark, path, df.schema)


def ended(df, keys, **values):
    df = df.withColumn("ends", F.lit(False))
    return df.unionByName(stateful.session_ends(df, keys, **values))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


@pytest.mark.parametrize("files", [1, 4, 9])
def test_life_cycle_and_alerts(spark, bars, files):
    want = signals.life_cycle(bars, 0.75, 2).cache()
    end = dt.datetime(2024, 9, 4, tzinfo=dt.UTC)
    marked = ended(bars, bars.select("symbol").distinct(), start_time=F.lit(end), arrival=F.lit(10_000))
    got = jobs.collect_updates(stateful.life_cycle(stored(spark, marked, files, "arrival"), "2 hours", 0.75, 2), "append")
    names = ("symbol", "start_time", "state", "event")
    assert rows(got, *names) == rows(want, *names) and {r.event for r in want.collect()} >= {None, "ENTRY", "STOP_LOSS", "TAKE_PROFIT", "INVALIDATED"}
    alerts = signals.debounce(want, 120)
    stream = stateful.debounce(stored(spark, ended(want, want.select("symbol").distinct(), start_time=F.lit(end)).where("event is not null"), files, "start_time"), "1 hour", 120)
    done = rows(jobs.collect_updates(stream, "append"), "symbol", "start_time", "event", "sent", "priority")
    held = [r for r in rows(alerts, "symbol", "start_time", "event", "sent", "priority")]
    assert set(done) <= set(held) and {r[3] for r in held} == {True, False}
    newest = max(r[1] for r in held)
    assert {r for r in held if newest - r[1] >= dt.timedelta(hours=1)} <= set(done)


def test_chain_of_signal_and_alerts(spark, bars):
    """Two stateful operators in one stream: the life of a signal, then its alerts."""
    end = dt.datetime(2024, 9, 4, tzinfo=dt.UTC)
    marked = ended(bars, bars.select("symbol").distinct(), start_time=F.lit(end), arrival=F.lit(10_000))
    tail = marked.where("not ends").unionByName(marked.where("ends")).unionByName(marked.where("ends").withColumns({"start_time": F.col("start_time") + F.expr("interval 2 days"), "arrival": F.lit(20_000).cast("long")}))
    chain = stateful.debounce(stateful.life_cycle(stored(spark, tail, 6, "arrival"), "2 hours", 0.75, 2), None, 120)
    want = signals.debounce(signals.life_cycle(bars, 0.75, 2), 120)
    names = ("symbol", "start_time", "event", "sent", "priority")
    assert rows(jobs.collect_updates(chain, "append"), *names) == rows(want, *names)


def test_alerts_are_forgotten(spark):
    """A pause after its last alert nothing is kept of a symbol: the state is no larger than the alerts of one pause."""
    at = lambda m: dt.datetime(2024, 9, 2, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(f"S{k}", at(30 * k), "ENTRY") for k in range(60)], "symbol string, start_time timestamp, event string")
    path, seen = f"{work_dir(spark)}/test-{uuid.uuid4().hex}", []
    stream = stateful.debounce(stored(spark, events, 20, "start_time"), "1 minute", 60)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, k: jobs.replace_batch(b, k, f"{path}/rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(f"{path}/rows").count() >= 58 and max(seen) <= 4 * 12 and len(seen) > 10
    assert stateful.Debounce(60, True).live


@pytest.mark.parametrize(("capacity", "files", "parts"), [(None, 1, 64), (None, 6, 64), (3, 4, 64), (3, 5, 1), (12, 7, 1000)])
def test_sequencer_and_session_end(spark, tape, monkeypatch, capacity, files, parts):
    monkeypatch.setattr(stateful, "PARTS", parts)
    want = sequence.sequence_bounded(tape, 60, capacity or 10_000, "symbol")
    marked = ended(tape, tape.select("symbol").distinct(), seq=F.lit(1000))
    got = jobs.collect_updates(stateful.sequencer(stored(spark, marked, files), 60, capacity, "symbol"), "append")
    names = ("symbol", "seq", "outcome", "release_seq")
    assert rows(got, *names) == rows(want, *names)
    assert {"ready", "late", "flush"} <= {r.outcome for r in want.collect()}


def test_stop_and_start_again(spark, tape):
    """A stream that stops after some batches, fails in one, and starts again gives the rows of one that never stopped."""
    marked = ended(tape, tape.select("symbol").distinct(), seq=F.lit(1000))
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    jobs.store_in_order(marked.where("seq < 140"), f"{path}/tape", 3)
    stream = lambda: stateful.sequencer(jobs.read_tape(spark, f"{path}/tape", marked.schema), 60, 5, "symbol")
    keep = lambda batch, k: jobs.replace_batch(batch, k, f"{path}/rows")
    jobs.run(stream(), path, keep, "append")
    part = jobs.read_batches(spark, f"{path}/rows", stream().schema).count()
    jobs.store_in_order(marked.where("seq >= 140"), f"{path}/tape", 3)
    tries = []

    def fails(batch, k):
        keep(batch, k)
        tries.append(k)
        if len(tries) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.run(stream(), path, fails, "append")
    jobs.run(stream(), path, fails, "append")
    assert tries[1] == tries[0]
    got = jobs.read_batches(spark, f"{path}/rows", stream().schema)
    names = ("symbol", "seq", "outcome", "release_seq")
    assert part and rows(got, *names) == rows(sequence.sequence_bounded(tape, 60, 5, "symbol"), *names)


@pytest.mark.parametrize("capacity", [2, 7, 1000])
def test_bounded_dedup(spark, tape, capacity):
    quotes = tape.where("kind = 'quote'")
    want = rows(dedup.mark_duplicates_bounded(quotes, capacity), "feed", "seq", "is_duplicate")
    assert rows(jobs.collect_updates(stateful.bounded_dedup(stored(spark, quotes, 5), capacity), "append"), "feed", "seq", "is_duplicate") == want


def test_a_batch_writes_what_it_changes(spark):
    """With many events waiting, a batch stores its own and the part that they fall into, not all that wait."""
    n = 40_000
    tape = spark.range(n + 200).select(F.lit("A").alias("feed"), F.col("id").alias("seq"), F.timestamp_seconds(START + F.col("id")).alias("ts"))
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    written = []
    for k, part in enumerate([tape.where(f"seq < {n}"), tape.where(f"seq >= {n}")]):
        part.coalesce(1).write.mode("append").parquet(f"{path}/tape")
        jobs.run(stateful.sequencer(jobs.read_tape(spark, f"{path}/tape", tape.schema), 50_000, 1_000_000), path, lambda b, j: jobs.replace_batch(b, j, f"{path}/rows"), "append")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint/state")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files, size = fs.listFiles(folder, True), 0
        while files.hasNext():
            f = files.next()
            size += f.getLen() if f.getPath().getName().endswith(".changelog") else 0
        written.append(size - sum(written))
    assert 0 < written[1] < 0.2 * written[0]


def test_silence_by_the_clock(spark):
    """A key that falls silent is reported although nothing else comes, and reported again when it is heard."""
    path = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    schema = "symbol string, seq long"
    spark.createDataFrame([("A", 1), ("B", 1)], schema).coalesce(1).write.parquet(f"{path}/in")
    stream, seen = stateful.silence(spark.readStream.schema(schema).parquet(f"{path}/in"), 2.0), []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, k: seen.extend(b.collect())).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while len(seen) < 2 and time.time() < until and query.isActive:
        time.sleep(0.3)
    first = sorted((r.symbol, r.silent_until) for r in seen)
    spark.createDataFrame([("A", 2)], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    while len(seen) < 3 and time.time() < until and query.isActive:
        time.sleep(0.3)
    query.stop()
    assert first == [("A", None), ("B", None)] and seen[2].symbol == "A" and seen[2].silent_until >= seen[2].silent_from


def test_life_is_the_frame():
    pdf = pd.DataFrame([("A", pd.Timestamp(2024, 1, 1) + pd.Timedelta(hours=k), 10.0 - k, 11.0 - k, True, True, 0.9, 9.5, 12.0) for k in range(9)], columns="symbol start_time low high is_valid passes score stop_loss take_profit".split())
    assert signals.life_frame(pdf)["event"].tolist()[:2] == ["ENTRY", "STOP_LOSS"] and signals.life_frame(pdf)["state"].tolist()[1:6] == ["COOLDOWN"] * 3 + ["IDLE", "ENTRY"]
