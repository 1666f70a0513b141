"""Late and out-of-order events: a watermark for a whole feed."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minus
from .scan import running
from .segments import Walk, walked


def sequence(tape: DataFrame, lateness: float, keys: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """tape with watermark_at_arrival and is_late. The watermark is the largest event time so far less lateness seconds; an
    event is late if it is older than the watermark before it, an equal one is kept. A watermark before 2000 doesn't count."""
    out = running(tape, minus(F.col("ts"), lateness), "watermark_at_arrival", "seq", keys, chunk, before=True)
    return out.withColumn("is_late", F.coalesce(F.col("ts") < F.col("watermark_at_arrival"), F.lit(False)))


def release(tape: DataFrame, lateness: float, keys: tuple[str, ...] = (), chunk: int | None = None, time_chunk: int = 86_400_000_000) -> DataFrame:
    """The events that aren't late with release_seq, the arrival at which each is let out (null: only when all is flushed),
    and release ('ready' or 'flush'). Replayed in order of (ts, seq).

    An event goes out at the first arrival, its own at the earliest, after which the watermark has reached it. The
    arrivals that raise the watermark and the events are brought in one order, latest first, and each event takes the
    least arrival among the thresholds at or above it; that again is a running maximum, of negated arrivals."""
    was, own = F.col("watermark_at_arrival"), minus(F.col("ts"), lateness)
    seen = sequence(tape, lateness, keys, chunk).withColumn("_now", F.greatest(was, own))
    none = F.lit(None).cast("long")
    event = F.when(~F.col("is_late"), F.struct((1 - 2 * F.unix_micros("ts")).alias("order"), none.alias("threshold")))
    rises = F.col("_now").isNotNull() & (was.isNull() | (F.col("_now") > was))
    rise = F.when(rises, F.struct((-2 * F.unix_micros("_now")).alias("order"), F.col("seq").alias("threshold")))
    both = seen.withColumn("_x", F.explode(F.array_compact(F.array(event, rise)))).withColumns({"_order": F.col("_x.order"), "_threshold": F.col("_x.threshold")}).drop("_x", "_now")
    both = running(both, -F.col("_threshold"), "_first", "_order", keys, 2 * time_chunk if chunk else None)
    out = both.where("_threshold is null").withColumn("release_seq", F.greatest(-F.col("_first"), F.when(F.col("_first").isNotNull(), F.col("seq"))))
    return out.withColumn("release", F.when(F.col("release_seq").isNull(), F.lit("flush")).otherwise(F.lit("ready"))).drop("_threshold", "_order", "_first")


def late_report(sequenced: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How many events came late, and by how many seconds at most."""
    late = sequenced.where("is_late").withColumn("late_by", (F.unix_micros("watermark_at_arrival") - F.unix_micros("ts")) / 1e6)
    return late.groupBy(*by).agg(F.count("*").alias("n_late"), F.max("late_by").alias("max_late_by"))


class Sequencer:
    """One feed's events in the order of their arrival, at most capacity of them waiting. While there are more, all events of
    the oldest time are let out and the watermark rises to it. Times and the lag are microseconds."""

    def __init__(self, lag: int, capacity: int | None = None, mark: int | None = None, waiting: list[tuple[int, int]] = ()):
        self.lag, self.capacity, self.mark, self.waiting = lag, capacity, mark, list(waiting)
        heapq.heapify(self.waiting)

    def push(self, seq: int, ts: int) -> list[tuple[int, str, int | None]]:
        """What comes of an arrival: (seq, outcome, release_seq); outcome is ready, evicted or late."""
        if self.mark is not None and ts < self.mark:
            return [(seq, "late", None)]
        out, waiting = [], self.waiting
        heapq.heappush(waiting, (ts, seq))
        self.mark = ts - self.lag if self.mark is None else max(self.mark, ts - self.lag)
        while self.capacity and len(waiting) > self.capacity:
            oldest = waiting[0][0]
            while waiting and waiting[0][0] == oldest:
                out.append((heapq.heappop(waiting)[1], "evicted", seq))
            self.mark = max(self.mark, oldest)
        while waiting and waiting[0][0] <= self.mark:
            out.append((heapq.heappop(waiting)[1], "ready", seq))
        return out

    def flush(self) -> list[tuple[int, str, None]]:
        return [(seq, "flush", None) for _, seq in sorted(self.waiting)]


class _Walk(Walk):
    def __init__(self, lag: int, capacity: int, state: bytes | None):
        mark, waiting = json.loads(state) if state else (None, [])
        self.now = Sequencer(lag, capacity, mark, [tuple(x) for x in waiting])

    def row(self, seq: int, value: int) -> list[tuple[int, str, int | None]]:
        return self.now.push(seq, value)

    def state(self) -> bytes:
        return json.dumps([self.now.mark, sorted(self.now.waiting)]).encode()

    def end(self) -> list[tuple[int, str, None]]:
        return self.now.flush()


def sequence_bounded(tape: DataFrame, lateness: float, capacity: int, key: str = "feed", chunk: int | None = None) -> DataFrame:
    """(key, seq, outcome, release_seq): as sequence, but with at most capacity events waiting; outcome is ready, evicted,
    late or flush. Each step depends on the one before: without chunk a feed is walked through in its arrival order by one
    task, batch by batch, which holds what waits and no more; with it a feed is cut at multiples of it and its stretches are
    walked at once, see segments.walked(), which makes its tables right away."""
    if chunk:
        lag = int(lateness * 1_000_000)
        rows = tape.select(F.col(key).cast("string").alias(key), "seq", F.unix_micros("ts").alias("value"))
        return walked(rows, key, chunk, lambda state: _Walk(lag, capacity, state))
    lag, names = int(lateness * 1_000_000), [key, "seq", "outcome", "release_seq"]

    def walk(batches):
        feed, now = None, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

        for batch in batches:
            out = []
            for k, seq, ts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if now is None or k != feed:
                    out += [(feed, *x) for x in now.flush()] if now else []
                    feed, now = k, Sequencer(lag, capacity)
                out += [(k, *x) for x in now.push(seq, ts)]
            yield table(out)
        if now:
            yield table([(feed, *x) for x in now.flush()])

    rows = tape.select(F.col(key).cast("string").alias(key), "seq", F.unix_micros("ts").alias("us"))
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(walk, f"{key} string, seq long, outcome string, release_seq long")


def replay_number(tape: DataFrame, chunk: int | None = None) -> DataFrame:
    """tape with place: the place of each event in its symbol's time order. chunk cuts that order, in microseconds."""
    rows = running(tape.withColumn("_order", F.unix_micros("ts")), F.lit(1), "place", "_order", ("symbol",), chunk, how="sum", ties=("seq",))
    return rows.withColumn("place", F.col("place").cast("int")).drop("_order")
