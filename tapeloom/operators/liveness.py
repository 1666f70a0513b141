"""Whether symbols and feeds are alive, by receive time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import normal_list
from .scan import running


def symbol_status(tape: DataFrame, watch: DataFrame, now: Column, threshold: float) -> DataFrame:
    """(symbol, last_seen, status) of watched symbols and of those that came unasked. From threshold seconds on, that
    included, a symbol is stale."""
    seen = tape.groupBy("symbol").agg(F.max("recv_ts").alias("last_seen"))
    both = normal_list(watch).withColumn("_w", F.lit(True)).join(seen, "symbol", "full")
    age = F.unix_micros(now) - F.unix_micros("last_seen")
    status = F.when(F.col("_w").isNull(), "Untracked").when(F.col("last_seen").isNull(), "NeverSeen").when(age >= threshold * 1_000_000, "Stale").otherwise("Active")
    return both.select("symbol", F.when(F.col("_w").isNotNull(), F.col("last_seen")).alias("last_seen"), status.alias("status"))


def stale_symbols(status: DataFrame) -> DataFrame:
    return status.where("status in ('Stale', 'NeverSeen')").select("symbol").orderBy("symbol")


def stale_intervals(tape: DataFrame, threshold: float, chunk: int | None = None) -> DataFrame:
    """(symbol, stale_from, stale_until): from threshold after an event to the next one; open at the end. Events of a symbol at
    one time are one. The next event is a running maximum of negated times, latest first; chunk cuts it, in microseconds."""
    times = tape.select("symbol", "recv_ts").distinct().withColumn("_back", -F.unix_micros("recv_ts"))
    after = running(times, F.col("_back"), "_next", "_back", ("symbol",), chunk, before=True)
    start = F.col("recv_ts") + F.make_dt_interval(secs=F.lit(threshold))
    out = after.select("symbol", start.alias("stale_from"), F.timestamp_micros(-F.col("_next")).alias("stale_until"))
    return out.where("stale_until is null or stale_from < stale_until")


def status_at(tape: DataFrame, watch: DataFrame, times: DataFrame, threshold: float, chunk: int | None = None) -> DataFrame:
    """(symbol, now, status) of watched symbols at each of the times(now): the last event at or before it is a running maximum
    over events and times together, which chunk cuts, in microseconds. Times are few."""
    asked = normal_list(watch).crossJoin(F.broadcast(times.select("now")))  # the schedule itself, not pairs of events
    rows = asked.select("symbol", F.col("now").alias("at"), F.lit(1).alias("_ask")).unionByName(tape.select("symbol", F.col("recv_ts").alias("at"), F.lit(0).alias("_ask")))
    rows = running(rows.withColumn("_order", F.unix_micros("at")), F.when(F.col("_ask") == 0, F.col("at")), "_last", "_order", ("symbol",), chunk, ties=("_ask",))
    age = F.unix_micros("at") - F.unix_micros("_last")
    status = F.when(F.col("_last").isNull(), "NeverSeen").when(age >= threshold * 1_000_000, "Stale").otherwise("Active")
    return rows.where("_ask = 1").select("symbol", F.col("at").alias("now"), status.alias("status"))


def feed_health(frames: DataFrame, now: Column, heartbeat: float, staleness: float, feeds: DataFrame | None = None) -> DataFrame:
    """(feed, last_message, health) by the last arrival; staleness is tested first, a clock that went back counts as age 0.
    feeds(feed) may list feeds that never sent a message."""
    last = frames.groupBy("feed").agg(F.max_by("recv_ts", "seq").alias("last_message"))
    if feeds is not None:
        last = feeds.select("feed").distinct().join(last, "feed", "left")
    age = F.greatest(F.unix_micros(now) - F.unix_micros("last_message"), F.lit(0)) / 1_000_000
    health = F.when(F.col("last_message").isNull(), "Dead").when(age >= staleness, "Stale").when(age >= heartbeat, "HeartbeatMissed").otherwise("Healthy")
    return last.select("feed", "last_message", health.alias("health"))
