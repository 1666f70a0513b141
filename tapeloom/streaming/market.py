"""Recorded or live frames as one stream: parsed, checked, mapped, put in order by symbol, and made into candles on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import map_symbols
from ..sources import frames as fr
from ..sources.sinks import read_candles, upsert_candles
from . import jobs, stateful

#: Keys that rows without a symbol are dealt over, so that rejects and control messages of a feed are no hot key.
BUCKETS = 64
#: A frame of this kind says that the session of all symbols is over.
SESSION_END = "session_end"
_EVENT = ("feed", "kind", "price", "volume", *fr.QUOTE_SIDES)
_CONTROL = ("feed", "msg_type")
_REJECT = ("feed", "error_kind", "error_reason", "is_exchange_error", "raw")


def tagged(frames: DataFrame, symbols: list[str]) -> DataFrame:
    """(key, tag, seq, us, payload, ends): frames as events of a symbol, control messages, rejects; the rest of a frame is its
    payload, a JSON object. A session's end becomes a row for each of the symbols. Events of no instrument are left out."""
    end = F.col("frame_kind") == SESSION_END
    converted = map_symbols(fr.convert(fr.parse(frames)))
    rows = converted.withColumn("tag", F.when(end, "end").when(F.col("status") == "event", "event").when(F.col("status") == "control", "control").otherwise("reject"))
    rows = rows.where("tag != 'event' or symbol is not null")
    side = lambda kind, c: F.when(F.col("msg_type") == kind, F.col(f"msg.{c}")).alias(c)
    event = F.to_json(F.struct("feed", F.col("msg_type").alias("kind"), side("trade", "price"), side("trade", "volume"), *(side("quote", c) for c in fr.QUOTE_SIDES)))
    payload = F.when(F.col("tag") == "event", event).when(F.col("tag") == "control", F.to_json(F.struct(*_CONTROL))).when(F.col("tag") == "reject", F.to_json(F.struct(*_REJECT)))
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("feed", "seq"), F.lit(BUCKETS)).cast("string"))
    keys = F.when(end, F.array(*map(F.lit, symbols))).when(F.col("tag") == "event", F.array("symbol")).otherwise(F.array(spread))
    return rows.select(F.explode(keys).alias("key"), "tag", "seq", F.unix_micros("ts").alias("us"), payload.alias("payload"), end.alias("ends"))


@dataclass(frozen=True)
class MarketTables:
    """What one stream of frames leaves: each a table that later batches add to; candles are replaced as they grow."""

    events: DataFrame
    late: DataFrame
    control: DataFrame
    rejects: DataFrame
    candles: DataFrame


def _keep(batch: DataFrame, batch_id: int, path: str, timeframe: str) -> None:
    us = lambda c: F.timestamp_micros(c)
    batch = batch.persist()
    try:
        ev = batch.where("tag = 'event'").select(F.col("key").alias("symbol"), "seq", us("us").alias("ts"), "outcome", "release_seq", F.from_json("payload", "feed string, kind string, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double").alias("p"))
        ev = ev.select("symbol", "seq", "ts", "outcome", "release_seq", "p.*")
        jobs.replace_batch(ev.where("outcome != 'late'"), batch_id, f"{path}/events")
        jobs.replace_batch(ev.where("outcome = 'late'"), batch_id, f"{path}/late")
        control = batch.where("tag = 'control'").select("seq", us("us").alias("ts"), F.from_json("payload", "feed string, msg_type string").alias("p"))
        jobs.replace_batch(control.select("seq", "ts", "p.*"), batch_id, f"{path}/control")
        reject = batch.where("tag = 'reject'").select("seq", F.from_json("payload", "feed string, error_kind string, error_reason string, is_exchange_error boolean, raw string").alias("p"))
        jobs.replace_batch(reject.select("seq", "p.*"), batch_id, f"{path}/rejects")
        made = batch.where("tag = 'candle'").select(
            F.col("key").alias("symbol"), F.lit(timeframe).alias("timeframe"), us("start").alias("start_time"), "open", "high", "low", "close", F.col("candle_volume").alias("volume"), "first_seq", "is_closed", "closed_by_seq"
        )
        upsert_candles(made, f"{path}/candles", batch_id)
    finally:
        batch.unpersist()


def run(frames: DataFrame, path: str, lateness: float, timeframe: str, symbols: list[str]) -> MarketTables:
    """Runs over the frames that there are, from where the last run under this path ended: one read and one parse, two stateful
    operators one behind the other, five tables. A batch that runs again after a failure leaves what it would have left."""
    spark = frames.sparkSession
    chain = stateful.with_candles(stateful.sequencing(tagged(frames, symbols), lateness), timeframe)
    jobs.run(chain, path, lambda batch, k: _keep(batch, k, path, timeframe), "append")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> MarketTables:
    sides = ", ".join(f"{c} double" for c in ("price", "volume", *fr.QUOTE_SIDES))
    event = f"symbol string, seq bigint, ts timestamp, outcome string, release_seq bigint, feed string, kind string, {sides}"
    table = lambda name, ddl: jobs.read_batches(spark, f"{path}/{name}", spark.createDataFrame([], ddl).schema)
    return MarketTables(
        table("events", event), table("late", event), table("control", "seq bigint, ts timestamp, feed string, msg_type string"),
        table("rejects", "seq bigint, feed string, error_kind string, error_reason string, is_exchange_error boolean, raw string"), read_candles(spark, f"{path}/candles"),
    )
