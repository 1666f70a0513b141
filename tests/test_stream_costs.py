"""What a micro-batch costs beside its rows: questions to the state store, and parts of the state."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators.dedup import Remembered
from tapeloom.paths import work_dir
from tapeloom.streaming import jobs, stateful


class Store:
    """A map state, or a value state, that counts what is asked of it."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def _ask(self):
        self.asked += 1

    def containsKey(self, k):
        self._ask()
        return k in self.rows

    def getValue(self, k):
        self._ask()
        return self.rows.get(k)

    def updateValue(self, k, v):
        self._ask()
        self.rows[k] = v

    def removeKey(self, k):
        self._ask()
        self.rows.pop(k, None)

    def iterator(self):
        self._ask()
        return iter(list(self.rows.items()))

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, v):
        self.rows[()] = v

    def clear(self):
        self.rows.clear()


class Handle:
    def __init__(self):
        self.made = {}

    def getMapState(self, name, *_):
        return self.made.setdefault(name, Store())

    getValueState = getMapState


@pytest.mark.parametrize(("capacity", "sizes"), [(50, [2000, 2000, 2000]), (50, [3, 1, 40, 7, 300, 2, 90]), (7, [1, 2, 3, 30, 4, 100, 5]), (1, [5, 5, 1, 1])])
def test_bounded_dedup_asks_for_what_is_remembered(capacity, sizes):
    r, handle, held, seq = random.Random(capacity), Handle(), Remembered(capacity), 0
    for size in sizes:
        quotes = [f"q{r.randrange(3 * capacity)}" for _ in range(size)]
        before = sum(s.asked for s in handle.made.values())
        now = stateful.Remembering(capacity)
        now.init(handle)
        frame = pd.DataFrame({"seq": range(seq, seq + size), "quote": quotes})
        got = pd.concat(now.handleInputRows(("F",), iter([frame[size // 2 :], frame[: size // 2]]), None))
        assert got["is_duplicate"].tolist() == [held.known(q) for q in quotes] and got["seq"].tolist() == list(range(seq, seq + size))
        assert {k[0] for k in handle.made["quotes"].rows} == set(held.keys)
        assert sum(s.asked for s in handle.made.values()) - before <= 5 * min(size, capacity) + 1
        seq += size


@pytest.mark.parametrize("lag", [0, 30, 500])
def test_sequencing_asks_for_what_waits_on(lag):
    """Events that come and go within a batch cost the state store nothing, and both walks let out the same."""
    r, handles, seq = random.Random(lag), (Handle(), Handle()), 0
    names = ["key", "tag", "seq", "us", "outcome", "release_seq", "payload"]
    for size in (400, 1, 7, 300, 60):
        rows = []
        for _ in range(size):
            seq += 1
            us = 10 * seq + r.choice([0, 0, -25, -90, 40])
            rows.append(("event" if r.random() < 0.9 else "reject", seq, us, f"p{seq}", False))
        if size == 7:
            rows[4] = ("end", seq - 2, None, None, True)
        frame, got = pd.DataFrame(rows, columns=["tag", "seq", "us", "payload", "ends"]), []
        for handle, capacity in zip(handles, (None, 10**6), strict=True):
            before = sum(s.asked for s in handle.made.values())
            now = stateful.Sequencing(lag, capacity, 1)
            now.init(handle)
            got.append(pd.concat(now.handleInputRows(("A",), iter([frame]), None)).astype(object))
            touched = sum(s.asked for s in handle.made.values()) - before
            assert touched <= 2 * (lag // 5 + 20)  # parts of one microsecond: those that waited, and those that wait
        flat = [sorted(str(tuple(None if pd.isna(x) else x for x in t)) for t in f[names].itertuples(index=False, name=None)) for f in got]
        assert flat[0] == flat[1] and handles[0].made["about"].rows == handles[1].made["about"].rows
        assert {k: sorted(zip(*v, strict=True)) for k, v in handles[0].made["parts"].rows.items()} == {k: sorted(zip(*v, strict=True)) for k, v in handles[1].made["parts"].rows.items()}


def test_state_has_parts_by_cores(spark):
    """A session with many shuffle partitions gives a stream no more parts of state than its cores can use, and keeps its setting."""
    path, was = f"{work_dir(spark)}/test-{uuid.uuid4().hex}", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        tape = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 9).alias("symbol"))
        jobs.store_in_order(tape, f"{path}/tape", 2)
        jobs.run(jobs.read_tape(spark, f"{path}/tape", tape.schema).groupBy("symbol").count(), path, lambda b, k: jobs.replace_batch(b, k, f"{path}/rows"), "update")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint/state/0")
    parts = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if s.getPath().getName().isdigit()]
    assert len(parts) == jobs.STATE_PARTS * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{path}/rows").groupBy("symbol").agg(F.max("count")).agg(F.sum("max(count)")).first()[0] == 100


@pytest.mark.parametrize("step", [7, 40])
def test_arrival_candles_by_column(step):
    """Candles of whole stretches are those of a plain loop over the trades, whatever the batches, and close where it closes them."""
    r, handle, got, want, seen, now = random.Random(step), Handle(), {}, {}, -1, None
    for batch in range(6):
        rows = [("A", "event", 100 * batch + k, 20 * batch + k + r.choice([0, 0, -9]), r.choice(["ready", "late"]), 100 * batch + k, "x", r.choice([1.5, 2.25, None]), r.random()) for k in range(30)]
        for _, _, seq, us, outcome, _, _, price, volume in rows:
            if outcome == "late" or price is None:
                continue
            seen = max(seen, us)
            if now and now[0] == seen // step * step:
                now[2:6] = max(now[2], price), min(now[3], price), price, now[5] + volume
            else:
                if now:
                    want[now[0]] = (*now, True, seq)
                now = [seen // step * step, price, price, price, price, volume, seq]
        want[now[0]] = (*now, batch == 5, None)
        if batch == 5:
            rows.append(("A", "end", 10**6, None, None, None, None, None, None))
        processor = stateful.ArrivalCandles(step)
        processor.init(handle)
        frame = pd.DataFrame(rows, columns=["key", "tag", "seq", "us", "outcome", "release_seq", "payload", "price", "volume"])
        out = pd.concat(processor.handleInputRows(("A",), iter([frame.sample(frac=1, random_state=1)]), None))
        assert (out["tag"] == "event").sum() == 30
        for c in out[out["tag"] == "candle"][["start", "open", "high", "low", "close", "candle_volume", "first_seq", "is_closed", "closed_by_seq"]].itertuples(index=False):
            got[c[0]] = tuple(None if pd.isna(x) else x for x in c)
    assert got == want and not handle.made["open"].rows
