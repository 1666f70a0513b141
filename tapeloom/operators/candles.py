"""Candles in several timeframes, and their bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running, time_place

# Seconds, closed candles kept, order.
TIMEFRAMES = {"M1": (60, 512), "M15": (900, 32), "H1": (3600, 8), "D1": (86400, 16)}


def _bucket(ts, step: int):
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def candles(trades: DataFrame, timeframe: str = "M1", mode: str = "arrival", chunk: int | None = None, order: str | None = None) -> DataFrame:
    """(symbol, timeframe, start_time, end_time, open, high, low, close, volume, first_seq).

    arrival: a trade goes to the bucket of the newest time its symbol has seen, so a late trade counts for the candle that
    is open then. event: each trade goes to its own bucket, open and close by (time, arrival). Empty buckets have no
    candle; buckets start at multiples of the step since 1970 in UTC. order names a number that follows seq, equal ones
    in order of seq, for chunks.
    """
    step = TIMEFRAMES[timeframe][0]
    if mode == "arrival":
        rows, at, place = running(trades, F.col("ts"), "_seen", order or "seq", ("symbol",), chunk, ties=("seq",) if order else ()), F.col("_seen"), F.col("seq")
    elif mode == "event":
        rows, at, place = trades, F.col("ts"), time_place(trades)
    else:
        raise ValueError("mode is 'arrival' or 'event'")
    made = rows.groupBy("symbol", _bucket(at, step).alias("start_time")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"), F.min("seq").alias("first_seq")
    )
    return _shaped(made, timeframe)


def closes(trades: DataFrame, timeframe: str) -> DataFrame:
    """(start_time, close) of event-time bars of all trades together, whose seq is a struct that begins with a number. The trades
    that are last by time and that number are found by a hash aggregate of a row a bar; the whole seq decides between them."""
    first = trades.schema["seq"].dataType.fieldNames()[0]
    rows = trades.withColumn("start_time", _bucket(F.col("ts"), TIMEFRAMES[timeframe][0]))
    rows = rows.withColumn("_place", time_place(rows.withColumn("seq", F.col(f"seq.{first}")), F.coalesce(F.col(f"seq.{first}"), F.lit(-1).cast("long"))))
    newest = rows.groupBy("start_time").agg(F.max("_place").alias("_place"))
    last = rows.join(F.broadcast(newest), ["start_time", "_place"])
    return last.groupBy("start_time").agg(F.max_by("price", F.struct("ts", "seq")).alias("close"))


def _shaped(made: DataFrame, timeframe: str) -> DataFrame:
    end = F.timestamp_seconds(F.unix_seconds("start_time") + TIMEFRAMES[timeframe][0])
    return made.select("symbol", F.lit(timeframe).alias("timeframe"), "start_time", end.alias("end_time"), "open", "high", "low", "close", "volume", "first_seq")


def roll_up(finer: DataFrame, timeframes: tuple[str, ...]) -> DataFrame:
    """Candles of the timeframes from those of a finer one whose step divides theirs: one row of it goes to the bucket that it
    lies in of each, and one aggregate makes them all."""
    step = F.element_at(F.create_map(*(F.lit(x) for t in timeframes for x in (t, TIMEFRAMES[t][0]))), F.col("_tf"))
    dealt = finer.drop("timeframe").withColumn("_tf", F.explode(F.array(*map(F.lit, timeframes)))).withColumn("_at", F.floor(F.unix_seconds("start_time") / step) * step)
    made = dealt.groupBy("symbol", F.col("_tf").alias("timeframe"), "_at", step.alias("_step")).agg(
        F.min_by("open", "start_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start_time").alias("close"), F.sum("volume").alias("volume"), F.min("first_seq").alias("first_seq")
    )
    return made.select("symbol", "timeframe", F.timestamp_seconds("_at").alias("start_time"), F.timestamp_seconds(F.col("_at") + F.col("_step")).alias("end_time"), "open", "high", "low", "close", "volume", "first_seq")


def all_timeframes(trades: DataFrame, timeframes: tuple[str, ...] = tuple(TIMEFRAMES), mode: str = "arrival", chunk: int | None = None, order: str | None = None) -> DataFrame:
    """Candles of every timeframe; trades are aggregated once, for the finest, and rolled up from there."""
    finest = min(timeframes, key=lambda t: TIMEFRAMES[t][0])
    return roll_up(candles(trades, finest, mode, chunk, order), timeframes)


def mark_closed(made: DataFrame) -> DataFrame:
    """With is_closed: all but the newest candle of a series, and closed_by_seq: the trade that closed it."""
    series = Window.partitionBy("symbol", "timeframe").orderBy("start_time")
    return made.withColumn("closed_by_seq", F.lead("first_seq").over(series)).withColumn("is_closed", F.col("closed_by_seq").isNotNull())


def close_events(marked: DataFrame) -> DataFrame:
    """Closed candles with the trade that closed them, in the order of the events: by trade, then by timeframe."""
    order = F.element_at(F.create_map(*(F.lit(x) for k, t in enumerate(TIMEFRAMES) for x in (t, k))), F.col("timeframe"))
    return marked.where("is_closed").withColumn("tf_order", order).orderBy("closed_by_seq", "tf_order")


def _newest(marked: DataFrame, capacity: dict[str, int] | int | None, more: int) -> DataFrame:
    """The newest candles of each series: as many as its timeframe keeps, and more. The limit of the roomiest timeframe is a
    literal, so Spark keeps no more of a series than that before the exchange."""
    room = {t: max(1, capacity if isinstance(capacity, int) else (capacity or {}).get(t, n)) for t, (_, n) in TIMEFRAMES.items()}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in room.items() for x in pair)), F.col("timeframe"))
    newest = F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy(F.desc("start_time")))
    ranked = marked.withColumn("_n", newest).where(F.col("_n") <= max(room.values()) + more)
    return ranked.where(F.col("_n") <= limit + more).drop("_n")


def history(marked: DataFrame, capacity: dict[str, int] | int | None = None) -> DataFrame:
    """The newest closed candles of each series, as many as its timeframe's capacity, one at least."""
    return _newest(marked.where("is_closed"), capacity, 0)


def kept(marked: DataFrame, capacity: dict[str, int] | int | None = None) -> DataFrame:
    """The open candle of each series and its history, in one pass."""
    return _newest(marked, capacity, 1)


def latest_closed(marked: DataFrame) -> DataFrame:
    return history(marked, 1)


def current(marked: DataFrame) -> DataFrame:
    return marked.where("not is_closed")


def symbol_count(made: DataFrame) -> DataFrame:
    return made.agg(F.count_distinct("symbol").alias("n_symbols"))


def symbols(made: DataFrame) -> DataFrame:
    return made.select("symbol").distinct().orderBy("symbol")
