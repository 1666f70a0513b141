"""Structured Streaming forms of the tape's jobs. Sources are files of the tape's schema, micro-batches end when they are read.

Jobs on event time (candles, dedup_quotes) leave lateness to Spark's watermark, which moves from one micro-batch to the next.
The others keep a state of their own for each feed or symbol and treat every row as if it came alone: they agree with the
operators' batch forms exactly, however the tape is cut into micro-batches, as long as these come in arrival order. A feed's
or symbol's share of one micro-batch is sorted in memory, so micro-batches bound it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.candles import TIMEFRAMES
from ..operators.dedup import SIDES, Remembered, quote_key
from ..operators.sequence import Sequencer
from ..paths import tidy, work_dir

#: Parts of a stream's state for each core, and micro-batches whose changes are kept: a stream starts again at its last one.
STATE_PARTS, KEPT_BATCHES = 2, 2


def store_in_order(tape: DataFrame, path: str, files: int, order: str = "seq", form: str = "parquet") -> None:
    """Writes the tape as that many more files, each a range of order, by all tasks at once. A file source takes files by their
    time, so each file then gets the time of its place, after all that were there."""
    spark = tape.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = lambda: {s.getPath().getName(): s for s in (fs.listStatus(folder) if fs.exists(folder) else ()) if s.getPath().getName().startswith("part-")}
    old = found()
    with tidy(spark):
        tape.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("append").format(form).save(path)
    new = [s for name, s in sorted(found().items()) if name not in old]
    after = max((s.getModificationTime() for s in old.values()), default=0)
    first = max(after, min((s.getModificationTime() for s in new), default=0) - 1000 * len(new))
    for k, s in enumerate(new, 1):
        fs.setTimes(s.getPath(), first + 1000 * k, -1)


def read_tape(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


# --- by event time ---------------------------------------------------------------------------------------------------


def candles(trades: DataFrame, timeframe: str, lateness: str) -> DataFrame:
    """Event-time candles; state is let go when the watermark passes a candle's end, and later trades for it are left out."""
    step = TIMEFRAMES[timeframe][0]
    made = trades.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", f"{step} seconds").alias("w"))
    place = F.struct("ts", "seq")
    made = made.agg(F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"))
    return made.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("start_time"), "open", "high", "low", "close", "volume")


def dedup_quotes(quotes: DataFrame, lateness: str) -> DataFrame:
    """First of equal quotes; the key holds the event time, so the watermark bounds what is remembered."""
    keyed = quotes.withWatermark("ts", lateness).withColumns({f"_{c}": F.col(c).cast("string") for c in SIDES})
    return keyed.dropDuplicatesWithinWatermark(["symbol", "ts", *(f"_{c}" for c in SIDES)]).drop(*(f"_{c}" for c in SIDES))


def latest(tape: DataFrame) -> DataFrame:
    """The newest trade and its price by symbol, in update mode."""
    trade = F.when(F.col("kind") == "trade", F.struct("ts", "seq"))
    return tape.groupBy("symbol").agg(F.max_by("price", trade).alias("last_price"), F.max("ts").alias("updated_at"))


# --- row by row ------------------------------------------------------------------------------------------------------


def _rows(frames: Iterator[pd.DataFrame], by: str = "seq") -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    """Rows as a frame; columns with nulls stay whole numbers."""
    out = pd.DataFrame(rows, columns=names.split())
    return out.astype({c: "Int64" for c in out if c.endswith(("_seq", "_us"))})


def accepted_volume(trades: DataFrame) -> DataFrame:
    """(symbol, total_volume, accepted, received) after each micro-batch: a trade older than the last accepted one of its
    symbol counts for nothing. A symbol's state is two numbers."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total = state.get if state.exists else (-1, 0.0)
        rows, accepted = _rows(frames), 0
        for us, volume in zip(rows["us"], rows["volume"], strict=True):
            if us >= seen:
                seen, total, accepted = int(us), total + float(volume), accepted + 1
        state.update((seen, total))
        yield pd.DataFrame({"symbol": [key[0]], "total_volume": [total], "accepted": [accepted], "received": [len(rows)]})

    rows = trades.select("symbol", "seq", F.unix_micros("ts").alias("us"), "volume")
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, total_volume double, accepted long, received long", "seen long, total double", "update", GroupStateTimeout.NoTimeout)


def sequencer(tape: DataFrame, lateness: float, capacity: int | None = None, key: str = "feed") -> DataFrame:
    """(key, seq, outcome, release_seq) of events as they are let out, or refused as late: the outcomes of
    sequence.sequence_bounded but flush, as what still waits stays in the state: a watermark and the waiting events."""
    lag = int(lateness * 1_000_000)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ts, seq = state.get if state.exists else (None, [], [])
        now = Sequencer(lag, capacity, mark, list(zip(ts, seq, strict=True)))
        rows = _rows(frames)
        out = [(k[0], *x) for s, us in zip(rows["seq"].tolist(), rows["us"].tolist(), strict=True) for x in now.push(s, us)]
        state.update((now.mark, [a for a, _ in now.waiting], [b for _, b in now.waiting]))
        yield _frame(out, f"{key} seq outcome release_seq")

    rows = tape.select(F.col(key).cast("string").alias(key), "seq", F.unix_micros("ts").alias("us"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, seq long, outcome string, release_seq long", "mark long, ts array<long>, seq array<long>", "append", GroupStateTimeout.NoTimeout)


def bounded_dedup(quotes: DataFrame, capacity: int, key: str = "feed", signed_zero: str = "distinct") -> DataFrame:
    """(key, seq, is_duplicate) of quotes, with the last capacity accepted ones of a feed remembered, which are its state."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Remembered(capacity, state.get[0] if state.exists else [])
        rows = _rows(frames)
        out = [(k[0], s, held.known(q)) for s, q in zip(rows["seq"].tolist(), rows["quote"].tolist(), strict=True)]
        state.update((list(held.keys),))
        yield _frame(out, f"{key} seq is_duplicate")

    rows = quotes.select(F.col(key).cast("string").alias(key), "seq", quote_key(signed_zero).alias("quote"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, seq long, is_duplicate boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def arrival_candles(trades: DataFrame, timeframe: str) -> DataFrame:
    """(symbol, timeframe, start_s, open, high, low, close, volume, first_seq, closed_by_seq): candles of a symbol by the newest
    time that it has seen, when a trade closes them, and the open one after each micro-batch. State is the open candle."""
    step_us = TIMEFRAMES[timeframe][0] * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, now, out = -1, None, []
        if state.exists:
            seen, *now = state.get
        rows = _rows(frames)
        for seq, us, price, volume in zip(*(rows[c].tolist() for c in ("seq", "us", "price", "volume")), strict=True):
            seen = max(seen, us)
            start = seen // step_us * step_us // 1_000_000
            if now and now[0] == start:
                now[2:6] = max(now[2], price), min(now[3], price), price, now[5] + volume
            else:
                if now:
                    out.append((key[0], timeframe, *now, seq))
                now = [start, price, price, price, price, volume, seq]
        out.append((key[0], timeframe, *now, None))
        state.update((seen, *now))
        yield _frame(out, "symbol timeframe start_s open high low close volume first_seq closed_by_seq")

    candle = "start_s long, open double, high double, low double, close double, volume double, first_seq long"
    rows = trades.select("symbol", "seq", F.unix_micros("ts").alias("us"), "price", "volume")
    return rows.groupBy("symbol").applyInPandasWithState(step, f"symbol string, timeframe string, {candle}, closed_by_seq long", f"seen long, {candle}", "update", GroupStateTimeout.NoTimeout)


def stale_intervals(tape: DataFrame, threshold: float, delay: str = "1 second") -> DataFrame:
    """(symbol, stale_from_us, stale_until_us) by receive time: a symbol's timer goes off threshold seconds after its last event,
    once the watermark, delay behind the newest receive time of all symbols, has passed that; the interval then is open. The
    next event closes it, under the same stale_from_us. Micro-batches come in order of receive time."""
    lag = int(threshold * 1_000_000)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,), out = state.get if state.exists else (None,), []
        if state.hasTimedOut:
            out.append((key[0], last + lag, None))
        else:
            for us in _rows(frames, "us")["us"].tolist():
                if last is not None and last + lag < us:
                    out.append((key[0], last + lag, us))
                last = us if last is None else max(last, us)
            state.update((last,))
            due = (last + lag) // 1000 + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                out.append((key[0], last + lag, None))
        yield _frame(out, "symbol stale_from_us stale_until_us")

    rows = tape.withWatermark("recv_ts", delay).select("symbol", "recv_ts", F.unix_micros("recv_ts").alias("us"))
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, stale_from_us long, stale_until_us long", "last long", "update", GroupStateTimeout.EventTimeTimeout)


# --- what is kept ----------------------------------------------------------------------------------------------------


def run(stream: DataFrame, path: str, keep: Callable[[DataFrame, int], None], mode: str) -> None:
    """Runs the stream over what there is. keep(batch, batch_id) may be called again with a batch after a failure, so it writes
    to a place of the batch's own and replaces what is there. A new stream's state lies in STATE_PARTS parts a core: every part
    costs each micro-batch a task, a worker and a commit, however few rows it gets. A batch leaves no shuffle files, and what
    is kept of its state to start again from goes with the batches after it."""
    spark = stream.sparkSession
    settings = {"spark.sql.shuffle.partitions": min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_PARTS * spark.sparkContext.defaultParallelism), "spark.sql.streaming.minBatchesToRetain": KEPT_BATCHES}
    was = {k: spark.conf.get(k) for k in settings}
    try:  # a stream takes the session's settings with it when it starts
        for k, v in settings.items():
            spark.conf.set(k, v)
        with tidy(spark):
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    query.awaitTermination()


def replace_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A batch's rows as the folder batch_id=..., in place of an earlier try."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What replace_batch wrote, with batch_id; no rows if there was no batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fields = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch_id bigint"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(path)


def into_tables(batch: DataFrame, batch_id: int, tables: dict[str, str]) -> None:
    """A batch's rows into several tables, by conditions; the batch is computed once."""
    batch = batch.persist()
    try:
        for path, where in tables.items():
            replace_batch(batch.where(where), batch_id, path)
    finally:
        batch.unpersist()


def collect_updates(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Runs the stream over what there is and gives its rows with batch_id, from a table in the shared folder."""
    path = f"{work_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run(stream, path, lambda batch, k: replace_batch(batch, k, f"{path}/rows"), mode)
    return read_batches(stream.sparkSession, f"{path}/rows", stream.schema)


def split_late(sequenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs a sequencer's stream over what there is: (rows let out, late rows), each with batch_id, as tables of their own in
    the shared folder."""
    spark, path = sequenced.sparkSession, f"{work_dir(sequenced.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        into_tables(batch, batch_id, {f"{path}/good": "outcome != 'late'", f"{path}/late": "outcome = 'late'"})

    run(sequenced, path, keep, "append")
    return tuple(read_batches(spark, f"{path}/{name}", sequenced.schema) for name in ("good", "late"))


def newest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(*(F.max_by(c, "batch_id").alias(c) for c in rest))
