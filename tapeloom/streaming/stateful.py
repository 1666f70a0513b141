"""Streams with state kept entry by entry: processors of transformWithState over the RocksDB state store.

A processor reads and writes only the entries that its batch touches; what waits stays on the executor's disk, and with
changelog checkpoints a batch stores its changes alone, however large the state is. Call use_rocksdb() on the session first.

Rows of a stream may carry ends, which is true in one more row of a key when its session is over: what waits then is let
out. session_ends() makes such rows for keys that are known, as a watch list is.

LifeCycle and Debounce walk a symbol's rows in time order: rows wait until the watermark has passed them, so the result is that
of the batch forms for any cut into micro-batches, whatever the order within the watermark's delay. Rows that come later
than that are dropped by Spark. Sequencing, BoundedDedup and ArrivalCandles go by arrival and need none; a key's share of a
micro-batch is sorted in memory.
"""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.candles import TIMEFRAMES
from ..operators.dedup import DEFAULT_CAPACITY, quote_key
from ..operators.signals import COOLDOWN_BARS, DEBOUNCE_MINUTES, MIN_SCORE, Life, priority

#: Parts that the time from the watermark to the newest event is cut into: a batch rewrites the parts that it touches.
PARTS = 64
#: Shares of the symbols, each a key of what goes by time; rows of such a share in an entry of its state.
SHARES, ENTRY_ROWS = 1024, 10_000


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB and checkpoint what a batch changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def session_ends(like: DataFrame, keys: DataFrame, **values) -> DataFrame:
    """A row of like's columns and ends for each row of keys, with the given values and else nulls; ends is true."""
    known = {f.name: f.dataType for f in like.schema}
    shown = [F.col(c) if c in keys.columns else (values[c] if c in values else F.lit(None)).cast(known[c]).alias(c) for c in known if c != "ends"]
    return keys.select(*shown, F.lit(True).alias("ends"))


def _with_ends(df: DataFrame) -> DataFrame:
    return df if "ends" in df.columns else df.withColumn("ends", F.lit(False))


def _sorted(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _none(x):
    """A value for a state: null in place of NaN, Python's own kinds."""
    return None if pd.isna(x) else x.item() if hasattr(x, "item") else x


# --- in time order ---------------------------------------------------------------------------------------------------


class InTimeOrder(StatefulProcessor):
    """Lets rows wait until the watermark has passed their us, or their owner's session ends, then walks through them in order. A
    key is a share of the symbols, since a question to the state store costs as much as many rows: what came in a batch
    waits in entries of arrays. Subclasses say what waits (fields, DDL, symbol and us among them), the columns of what a row
    belongs to (owner), and what a row makes of its owner's state."""

    fields: str
    owner: list[str]
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = dict(f.split() for f in self.fields.split(", "))
        self.rest = [c for c in self.kinds if c not in ("symbol", "us")]
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{kind}>" for c, kind in self.kinds.items()))
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def walk(self, owners: list[tuple], us: list[int], rows: list[tuple]) -> list[tuple]:
        """What each row brings about, as the columns of out behind symbol and start_time; rows are in time order, those of an
        owner among others'."""
        raise NotImplementedError

    def _plain(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The columns that wait, of their own kinds: a missing number is NaN, a missing boolean false."""
        as_kind = {"double": lambda x: x.to_numpy("float64", na_value=np.nan), "long": lambda x: x.to_numpy("int64"), "boolean": lambda x: x.eq(True).to_numpy(bool), "string": lambda x: x.to_numpy(object)}
        return pd.DataFrame({c: as_kind[kind](frame[c]) for c, kind in self.kinds.items()})

    def _owners(self, rows: pd.DataFrame) -> list[tuple]:
        return [*zip(*(rows[c].tolist() for c in self.owner), strict=True)]

    def _wait(self, rows: pd.DataFrame) -> None:
        """Rows that wait from now on, beside those that do, and a timer for the first of them."""
        for k in range(0, len(rows), ENTRY_ROWS):
            self.waiting.appendValue(tuple(rows[c].iloc[k : k + ENTRY_ROWS].tolist() for c in self.kinds))
        if len(rows):
            self.handle.registerTimer(-(-int(rows["us"].min()) // 1000))

    def _held(self) -> list[pd.DataFrame]:
        return [self._plain(pd.DataFrame(dict(zip(self.kinds, entry, strict=True)))) for entry in self.waiting.get()]

    def _let_go(self, rows: pd.DataFrame, now: np.ndarray) -> Iterator[pd.DataFrame]:
        """Walks through the rows of now; the others are all that waits then."""
        self.waiting.clear()
        self._wait(rows[~now])
        ready = rows[now].sort_values("us", kind="stable")
        if len(ready):
            made = self.walk(self._owners(ready), ready["us"].tolist(), [*zip(*(ready[c].tolist() for c in self.rest), strict=True)])
            frame = pd.DataFrame(made, columns=self.out[2:], dtype=object)
            frame.insert(0, "symbol", ready["symbol"].to_numpy(object))
            frame.insert(1, "start_time", pd.to_datetime(ready["us"].to_numpy(), unit="us"))
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        ends = rows["ends"].eq(True).to_numpy(bool)
        new = self._plain(rows[~ends])
        if ends.any():
            over, both = {*self._owners(rows[ends])}, pd.concat([*self._held(), new], ignore_index=True)
            yield from self._let_go(both, np.fromiter((o in over for o in self._owners(both)), bool, len(both)))
        else:
            self._wait(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if held := self._held():
            rows = pd.concat(held, ignore_index=True)
            now = (rows["us"] <= mark).to_numpy()
            if now.any():
                yield from self._let_go(rows, now)
            else:
                self.handle.registerTimer(-(-int(rows["us"].min()) // 1000))
        self.passed(mark)

    def passed(self, mark: int) -> None:
        """What else is over when the watermark, in microseconds, has come that far."""

    def close(self) -> None:
        pass


def _by_share(rows: DataFrame, processor: InTimeOrder, shape: str) -> DataFrame:
    """rows(symbol, start_time, ends, and what waits but us) through a processor, dealt by shares of the symbols."""
    names = [c for c in (f.split()[0] for f in processor.fields.split(", ")) if c != "us"]
    share = F.pmod(F.xxhash64("symbol"), F.lit(SHARES)).cast("int").alias("share")
    dealt = rows.select(share, *names, F.unix_micros("start_time").alias("us"), "start_time", "ends")
    return dealt.groupBy("share").transformWithStateInPandas(processor, shape, "Append", "EventTime", eventTimeColumnName="start_time")


class LifeCycle(InTimeOrder):
    """The life of a symbol's signal: by symbol a value (state, bars left of the cool-down, stop, target), which idle symbols lack
    until their first entry, and the bars that wait."""

    fields = "symbol string, us long, low double, high double, is_valid boolean, passes boolean, score double, stop_loss double, take_profit double"
    owner = ["symbol"]
    out = ["symbol", "start_time", "state", "event"]

    def __init__(self, min_score: float, cooldown: int):
        self.min_score, self.cooldown = min_score, cooldown

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getMapState("life", "symbol string", "state string, remaining int, stop double, target double")

    def walk(self, owners: list[tuple], us: list[int], rows: list[tuple]) -> list[tuple]:
        kept, lives, out = dict(self.life.iterator()), {}, []
        for owner, row in zip(owners, rows, strict=True):
            life = lives.get(owner)
            if life is None:
                life = lives[owner] = Life(self.min_score, self.cooldown, *kept.get(owner, ()))
            event = life.bar(*row)
            out.append((life.state, event))
        for owner, life in lives.items():
            if (now := (life.state, life.left, life.stop, life.target)) != kept.get(owner, ("IDLE", 0, 0.0, 0.0)):
                self.life.updateValue(owner, now)
        return out


def life_cycle(bars: DataFrame, lateness: str, min_score: float = MIN_SCORE, cooldown: int = COOLDOWN_BARS) -> DataFrame:
    """(symbol, start_time, state, event) as signals.life_cycle gives it, of a stream of bars; append mode."""
    return _by_share(_with_ends(bars).withWatermark("start_time", lateness), LifeCycle(min_score, cooldown), "symbol string, start_time timestamp, state string, event string")


class Debounce(InTimeOrder):
    """When an alert last went out: by symbol and alert a value that is forgotten when the watermark is minutes beyond it. With live,
    the state store forgets it too, by the clock, minutes after it was written; that fits streams whose times are the clock's."""

    fields = "symbol string, event string, us long"
    owner = ["symbol", "event"]
    out = ["symbol", "start_time", "event", "sent"]

    def __init__(self, minutes: int, live: bool):
        self.pause, self.live = minutes * 60_000_000, live

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "symbol string, event string", "us long", ttlDurationMs=self.pause // 1000 if self.live else None)

    def walk(self, owners: list[tuple], us: list[int], rows: list[tuple]) -> list[tuple]:
        kept = {owner: at for owner, (at,) in self.sent.iterator()}
        last, out = dict(kept), []
        for owner, at in zip(owners, us, strict=True):
            due = owner not in last or at - last[owner] >= self.pause
            if due:
                last[owner] = at
            out.append((owner[1], due))
        changed = {owner: at for owner, at in last.items() if kept.get(owner) != at}
        for owner, at in changed.items():
            self.sent.updateValue(owner, (at,))
        for at in {*changed.values()}:
            self.handle.registerTimer(-(-(at + self.pause) // 1000))
        return out

    def passed(self, mark: int) -> None:
        for owner, (at,) in list(self.sent.iterator()):
            if at + self.pause <= mark:
                self.sent.removeKey(owner)


def debounce(events: DataFrame, lateness: str | None = None, minutes: int = DEBOUNCE_MINUTES, live: bool = False) -> DataFrame:
    """events(symbol, start_time, event) with priority and sent, as signals.debounce gives it, of a stream; append mode.
    lateness is left out where the stream has a watermark already, as life_cycle's has."""
    rows = _with_ends(events.where("event is not null"))
    out = _by_share(rows.withWatermark("start_time", lateness) if lateness else rows, Debounce(minutes, live), "symbol string, start_time timestamp, event string, sent boolean")
    return priority(out)


# --- by arrival ------------------------------------------------------------------------------------------------------


class Waiting:
    """Events that wait, in parts by time, each an entry of a map; parts are read when something asks for them, and written or
    removed at the end if they changed."""

    def __init__(self, parts, known: list[int], width: int):
        self.parts, self.width, self.held, self.known, self.stored = parts, width, {}, set(known), frozenset(known)
        self.order = list(known)
        heapq.heapify(self.order)

    def _part(self, p: int) -> list[tuple]:
        if p not in self.held:
            got = self.parts.getValue((p,)) if p in self.stored else ([], [], [])
            self.held[p] = [*zip(*got, strict=True)]  # stored as a heap, so it is one
        return self.held[p]

    def push(self, event: tuple) -> None:
        p = event[0] // self.width
        part = self._part(p)
        if p not in self.known:
            self.known.add(p)
            heapq.heappush(self.order, p)
        heapq.heappush(part, event)

    def first(self) -> tuple | None:
        while self.order:
            if part := self._part(self.order[0]):
                return part[0]
            self.known.discard(heapq.heappop(self.order))
        return None

    def pop(self) -> tuple:
        return heapq.heappop(self._part(self.order[0]))

    def store(self) -> list[int]:
        """Writes what changed; the parts that there are."""
        for p, part in self.held.items():
            if part:
                ts, seq, payload = zip(*part, strict=True)
                self.parts.updateValue((p,), (list(ts), list(seq), list(payload)))
            elif p in self.stored:
                self.parts.removeKey((p,))
        return sorted(p for p in self.known if p not in self.held or self.held[p])


#: Columns of texts, which an empty frame, or one of nulls alone, would have as numbers.
_TEXTS = dict.fromkeys(("key", "tag", "outcome", "payload"), object)


def _let_out(events: list[tuple], outcome: str, release_seq) -> pd.DataFrame:
    """Events that have waited, as rows."""
    ts, seq, payload = zip(*events, strict=True) if events else ((), (), ())
    frame = pd.DataFrame({"tag": "event", "seq": np.array(seq, "int64"), "us": pd.array(ts, "Int64"), "outcome": outcome, "payload": np.array(payload, object)})
    return frame.assign(release_seq=pd.array([None] * len(events) if release_seq is None else release_seq, "Int64"))


class Sequencing(StatefulProcessor):
    """One key's events by arrival: the outcomes of sequence.sequence_bounded, flush at the end of the session. A value holds the
    watermark, how many wait, and the numbers of the parts that they wait in. Rows whose tag is not event pass as they are."""

    def __init__(self, lag: int, capacity: int | None, width: int):
        self.lag, self.capacity, self.width = lag, capacity, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "mark long, n long, parts array<long>")
        self.parts = handle.getMapState("parts", "part long", "ts array<long>, seq array<long>, payload array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, n, known = self.about.get() if self.about.exists() else (None, 0, [])
        waiting, rows, out = Waiting(self.parts, list(known), self.width), _sorted(rows, ["seq"]), []
        events, ends = (rows["tag"] == "event").to_numpy(bool), rows["ends"].to_numpy(bool)
        us = rows["us"].to_numpy("float64", na_value=0).astype("int64") if rows["us"].dtype.kind == "f" else rows["us"].to_numpy("int64", na_value=0)
        seqs, payloads = rows["seq"].to_numpy("int64"), rows["payload"].to_numpy(object)
        passed = rows[~events & ~ends]
        if len(passed):
            out.append(passed.assign(outcome=None, release_seq=pd.array([None] * len(passed), "Int64"), us=passed["us"].astype("Int64")))
        first = 0
        for last in [*np.flatnonzero(ends), len(rows)]:
            own = np.arange(first, last)[events[first:last] & ~ends[first:last]]
            if len(own):
                step = self._walk if self.capacity else self._stretch
                made, mark, n = step(seqs[own], us[own], payloads[own], waiting, mark, n)
                out.append(made)
            if last < len(rows):
                rest = []
                while waiting.first():
                    rest.append(waiting.pop())
                out.append(_let_out(rest, "flush", None))
                out.append(pd.DataFrame({"tag": ["end"], "seq": [seqs[last]]}))
                mark, n = None, 0
            first = last + 1
        self.about.update((mark, n, waiting.store()))
        frame = pd.concat([f for f in out if len(f)]) if any(map(len, out)) else pd.DataFrame()
        yield frame.assign(key=key[0]).reindex(columns=["key", "tag", "seq", "us", "outcome", "release_seq", "payload"]).astype({**_TEXTS, "seq": "int64", "us": "Int64", "release_seq": "Int64"})

    def _stretch(self, seq, ts, payload, waiting: Waiting, mark: int | None, n: int) -> tuple[pd.DataFrame, int, int]:
        """What becomes of events where any number may wait: an event is let out by the first that brings the watermark to it. Only
        those that waited before, or wait on, pass the heap."""
        after = np.maximum.accumulate(ts - self.lag)
        after = after if mark is None else np.maximum(after, mark)
        late = np.zeros(len(ts), bool) if mark is None else ts < mark
        late[1:] |= ts[1:] < after[:-1]
        mark, held = int(after[-1]), []
        while (head := waiting.first()) and head[0] <= mark:
            held.append(waiting.pop())
        by = np.maximum(np.searchsorted(after, ts), np.arange(len(ts)))
        ready = ~late & (by < len(ts))
        rest = np.flatnonzero(~late & ~ready)
        for event in zip(ts[rest].tolist(), seq[rest].tolist(), map(_none, payload[rest]), strict=True):
            waiting.push(event)
        told = late | ready
        own = pd.DataFrame({"tag": "event", "seq": seq[told], "us": pd.array(ts[told], "Int64"), "outcome": np.where(late[told], "late", "ready")})
        own["release_seq"] = pd.arrays.IntegerArray(seq[np.minimum(by, len(ts) - 1)][told], late[told])
        own["payload"] = payload[told]
        before = _let_out(held, "ready", seq[np.searchsorted(after, [h[0] for h in held])] if held else None)
        return pd.concat([f for f in (before, own) if len(f)] or [own]), mark, n + len(rest) - len(held)

    def _walk(self, seqs, us, payloads, waiting: Waiting, mark: int | None, n: int) -> tuple[pd.DataFrame, int, int]:
        """The same, event by event, where no more than capacity may wait."""
        out = []

        def let_out(outcome: str, seq: int) -> None:
            ts, own, payload = waiting.pop()
            out.append(("event", own, ts, outcome, seq, payload))

        for seq, ts, payload in zip(seqs.tolist(), us.tolist(), map(_none, payloads), strict=True):
            if mark is not None and ts < mark:
                out.append(("event", seq, ts, "late", None, payload))
                continue
            waiting.push((ts, seq, payload))
            n += 1
            mark = ts - self.lag if mark is None else max(mark, ts - self.lag)
            while n > self.capacity:
                oldest = waiting.first()[0]
                while (head := waiting.first()) and head[0] == oldest:
                    let_out("evicted", seq)
                    n -= 1
                mark = max(mark, oldest)
            while (head := waiting.first()) and head[0] <= mark:
                let_out("ready", seq)
                n -= 1
        made = pd.DataFrame(out, columns=["tag", "seq", "us", "outcome", "release_seq", "payload"])
        return made.astype({"us": "Int64", "release_seq": "Int64"}), mark, n

    def close(self) -> None:
        pass


_SEQUENCED = "key string, tag string, seq long, us long, outcome string, release_seq long, payload string"


def sequencing(tagged: DataFrame, lateness: float, capacity: int | None = None) -> DataFrame:
    """(key, tag, seq, us, outcome, release_seq, payload) of tagged(key, tag, seq, us, payload[, ends]): events in the order of
    their arrival are let out in time order, or refused as late; other rows pass; a row with tag end follows what a session's
    end let out. payload is a text that goes with an event."""
    lag = int(lateness * 1_000_000)
    rows = _with_ends(tagged).select("key", "tag", "seq", "us", "payload", "ends")
    return rows.groupBy("key").transformWithStateInPandas(Sequencing(lag, capacity, max(1, lag // PARTS)), _SEQUENCED, "Append", "None")


def sequencer(tape: DataFrame, lateness: float, capacity: int | None = None, key: str = "feed") -> DataFrame:
    """(key, seq, outcome, release_seq) of the events of tape(key, seq, ts[, ends]), those of sequence.sequence_bounded; flush at
    the end of a session, after which the key starts anew."""
    tagged = tape.select(F.col(key).cast("string").alias("key"), F.lit("event").alias("tag"), "seq", F.unix_micros("ts").alias("us"), F.lit(None).cast("string").alias("payload"), *(["ends"] if "ends" in tape.columns else []))
    return sequencing(tagged, lateness, capacity).where("tag = 'event'").select(F.col("key").alias(key), "seq", "outcome", "release_seq")


class Remembering(StatefulProcessor):
    """The last capacity accepted quotes of a key: a map of the quotes, one of their places in a ring, and how many there were."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quotes, self.ring = handle.getMapState("quotes", "quote string", "place long"), handle.getMapState("ring", "place long", "quote string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, new, added, left, out = self.count.get()[0] if self.count.exists() else 0, {}, [], set(), []
        was, rows = n, _sorted(rows, ["seq"])
        held = rows["quote"].size >= min(n, self.capacity)  # asking for all that is remembered once costs less than asking for each row
        kept = {q: at for (q,), (at,) in self.quotes.iterator()} if held else {}
        placed = {at: q for q, at in kept.items()}
        stored = kept.__contains__ if held else lambda q: self.quotes.containsKey((q,))
        for quote in rows["quote"].tolist():
            known = quote in new or (quote not in left and stored(quote))
            out.append(known)
            if known:
                continue
            if n >= self.capacity:
                place = n - self.capacity
                if place >= was:
                    new.pop(added[place - was])
                else:
                    left.add(placed[place] if held else self.ring.getValue((place % self.capacity,))[0])
            new[quote] = n
            added.append(quote)
            n += 1
        for quote in left - new.keys():
            self.quotes.removeKey((quote,))
        for quote, place in new.items():
            self.quotes.updateValue((quote,), (place,))
            self.ring.updateValue((place % self.capacity,), (quote,))
        self.count.update((n,))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "is_duplicate": out})

    def close(self) -> None:
        pass


def bounded_dedup(quotes: DataFrame, capacity: int, key: str = "feed", signed_zero: str = "distinct") -> DataFrame:
    """(key, seq, is_duplicate) of a stream of quotes, as dedup.mark_duplicates_bounded gives it."""
    rows = quotes.select(F.col(key).cast("string").alias("key"), "seq", quote_key(signed_zero).alias("quote"))
    out = rows.groupBy("key").transformWithStateInPandas(Remembering(capacity or DEFAULT_CAPACITY), "key string, seq long, is_duplicate boolean", "Append", "None")
    return out.withColumnRenamed("key", key)


class Silence(StatefulProcessor):
    """Whether a key has been silent for too long by the clock: its last message, and a timer of the clock, which goes off
    although nothing comes."""

    def __init__(self, threshold_ms: int):
        self.threshold = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        was, silent = self.last.get() if self.last.exists() else (None, False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.threshold)
        self.last.update((now, False))
        yield pd.DataFrame([(key[0], pd.Timestamp(was + self.threshold, unit="ms"), pd.Timestamp(now, unit="ms"))] if silent else [], columns=["key", "silent_from", "silent_until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.update((last, True))
        yield pd.DataFrame([(key[0], pd.Timestamp(last + self.threshold, unit="ms"), pd.NaT)], columns=["key", "silent_from", "silent_until"])

    def close(self) -> None:
        pass


def silence(messages: DataFrame, threshold: float, key: str = "symbol") -> DataFrame:
    """(key, silent_from, silent_until) by the clock of the cluster: a row without silent_until when a key has sent nothing for
    threshold seconds, though no other message comes, and one with it when the key is heard again. Update mode."""
    out = messages.select(F.col(key).cast("string").alias("key")).groupBy("key").transformWithStateInPandas(Silence(int(threshold * 1000)), "key string, silent_from timestamp, silent_until timestamp", "Update", "ProcessingTime")
    return out.withColumnRenamed("key", key)


class ArrivalCandles(StatefulProcessor):
    """Candles of a key's released trades; the state is the open candle. Other rows pass. A candle goes out when a trade or the end
    of the session closes it, and, open, after each micro-batch that changed it."""

    def __init__(self, step_us: int):
        self.step = step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seen long, start long, open double, high double, low double, close double, volume double, first_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        trades = rows[((rows["tag"] == "event") & (rows["outcome"] != "late") & rows["price"].notna()).to_numpy(bool)]
        trades = trades.assign(_at=trades["release_seq"].astype("Int64").fillna((1 << 63) - 1)).sort_values(["_at", "us", "seq"], kind="stable")
        seen, *now = self.open.get() if self.open.exists() else (-1, None)
        now, out = (now if now[0] is not None else []), []

        def candle(closed: bool, by: int | None) -> None:
            out.append((key[0], "candle", *now, closed, by))

        if len(trades):
            times = np.maximum(np.maximum.accumulate(trades["us"].to_numpy("int64")), seen)
            starts, seen = times // self.step * self.step, int(times[-1])
            seqs, prices, volumes = (trades[c].tolist() for c in ("seq", "price", "volume"))
            cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
            for a, b in pairwise(cuts):
                start, high, low, volume = int(starts[a]), max(prices[a:b]), min(prices[a:b]), volumes[a:b]
                if now and now[0] == start:
                    now[2:6] = max(now[2], high), min(now[3], low), prices[b - 1], reduce(operator.add, volume, now[5])
                else:
                    if now:
                        candle(True, int(seqs[a]))
                    now = [start, prices[a], high, low, prices[b - 1], reduce(operator.add, volume), int(seqs[a])]
        if (rows["tag"] == "end").any():
            if now:
                candle(True, None)
            now = []
        elif len(trades):
            candle(False, None)
        if now:
            self.open.update((seen, *now))
        else:
            self.open.clear()
        made = pd.DataFrame(out, columns=["key", "tag", "start", "open", "high", "low", "close", "candle_volume", "first_seq", "is_closed", "closed_by_seq"])
        passed = rows[rows["tag"] != "end"]
        both = pd.concat([passed.astype({"us": "Int64", "release_seq": "Int64"}), made.astype({"start": "Int64", "first_seq": "Int64", "closed_by_seq": "Int64"})]) if len(made) else passed
        both = both.reindex(columns=_NAMES).astype({c: "Int64" for c in ("seq", "us", "release_seq", "start", "first_seq", "closed_by_seq")})
        yield both.astype({"is_closed": "boolean"})

    def close(self) -> None:
        pass


_CANDLED = f"{_SEQUENCED}, price double, volume double, start long, open double, high double, low double, close double, candle_volume double, first_seq long, is_closed boolean, closed_by_seq long"
_NAMES = [f.split()[0] for f in _CANDLED.split(", ")]


def with_candles(sequenced: DataFrame, timeframe: str) -> DataFrame:
    """The rows of sequencing(), whose payloads are JSON objects that may have price and volume, and rows with tag candle."""
    own = F.from_json("payload", "price double, volume double")
    rows = sequenced.withColumn("_own", own).select("*", "_own.price", "_own.volume").drop("_own")
    return rows.groupBy("key").transformWithStateInPandas(ArrivalCandles(TIMEFRAMES[timeframe][0] * 1_000_000), _CANDLED, "Append", "None")
