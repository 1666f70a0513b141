"""Set expressions against plain loops on random tapes out of order."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import candles, dedup, indicators, latest, scan, sequence, signals
from tests.test_scenarios import trades


def random_tape(seed, n=60):
    r = random.Random(seed)
    return [(r.randrange(300) + k, r.randrange(1, 50), r.randrange(1, 9)) for k in range(n)]


@pytest.mark.parametrize("chunk", [None, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_sequencer_is_the_loop(spark, seed, chunk):
    rows, lag = random_tape(seed), 40
    mark, waiting, want = None, [], {}
    for seq, (ts, *_) in enumerate(rows):
        if mark is not None and ts < mark:
            continue
        waiting.append((ts, seq))
        mark = ts - lag if mark is None else max(mark, ts - lag)
        for item in [x for x in waiting if x[0] <= mark]:
            waiting.remove(item)
            want[item[1]] = seq
    want |= {seq: None for _, seq in waiting}
    got = {r.seq: r.release_seq for r in sequence.release(trades(spark, *rows), lag, chunk=chunk).collect()}
    assert got == want
    bounded = sequence.sequence_bounded(trades(spark, *rows), lag, 10_000).where("outcome != 'late'")
    assert {r.seq: r.release_seq for r in bounded.collect()} == want


@pytest.mark.parametrize("capacity", [1, 2, 5])
def test_eviction_is_the_loop(spark, capacity):
    """While more than capacity wait, all of the oldest time go and the watermark rises to it."""
    rows, lag = random_tape(capacity, 90), 70
    mark, waiting, want = None, [], []
    for seq, (ts, *_) in enumerate(rows):
        if mark is not None and ts < mark:
            want.append((seq, "late", None))
            continue
        waiting.append((ts, seq))
        mark = max(mark if mark is not None else ts - lag, ts - lag)
        while len(waiting) > capacity:
            oldest = min(t for t, _ in waiting)
            want += [(s, "evicted", seq) for t, s in waiting if t == oldest]
            waiting, mark = [x for x in waiting if x[0] != oldest], max(mark, oldest)
        want += [(s, "ready", seq) for t, s in waiting if t <= mark]
        waiting = [x for x in waiting if x[0] > mark]
    want += [(s, "flush", None) for _, s in waiting]
    got = [(r.seq, r.outcome, r.release_seq) for r in sequence.sequence_bounded(trades(spark, *rows), lag, capacity).collect()]
    assert sorted(got) == sorted(want) and {"evicted", "late"} <= {x[1] for x in want}


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_bounded_dedup_is_the_loop(spark, capacity):
    r = random.Random(capacity)
    rows = [(k, "F", "quote", r.choice("AB"), r.randrange(3), float(r.randrange(2)), 1.0, 2.0, r.choice([0.0, -0.0])) for k in range(80)]
    df = spark.createDataFrame(rows, "seq long, feed string, kind string, symbol string, s long, bid_price double, bid_vol double, ask_price double, ask_vol double").withColumn("ts", F.timestamp_seconds("s"))
    for signed_zero in ("distinct", "equal"):
        known, want = [], []
        for seq, *_, symbol, s, bid, bv, ask, av in ((x[0], *x[3:]) for x in rows):
            k = (symbol, s, bid, bv, ask, str(av) if signed_zero == "distinct" else av)
            want.append((seq, k in known))
            if k not in known:
                known = [*known, k][-capacity:]
        assert sorted((x.seq, x.is_duplicate) for x in dedup.mark_duplicates_bounded(df, capacity, signed_zero=signed_zero).collect()) == want


def test_running_values_in_levels(spark, monkeypatch):
    """Cuts of cuts, for one key and for several, with gaps, nulls and ties."""
    r = random.Random(4)
    rows = [(r.choice("AB"), k + 50 * (k > 40), k // 2 * 2, None if k % 7 == 3 else r.randrange(-9, 9)) for k in range(120)]
    df = spark.createDataFrame(rows, "symbol string, seq long, at long, v long")
    monkeypatch.setattr(scan, "LEVEL", 3)
    for keys in ((), ("symbol",)):
        for how in ("max", "sum"):
            for before in (False, True):
                got = [sorted(map(tuple, scan.running(df, F.col("v"), "out", "at", keys, chunk, before, how, ("seq",)).collect()), key=str) for chunk in (None, 4)]
                assert got[0] == got[1]
    assert scan.running(df.limit(0), F.col("v"), "out", "at", (), 4).count() == 0


@pytest.mark.parametrize("chunk", [None, 5])
def test_state_and_candles_are_the_loop(spark, chunk):
    rows = random_tape(3)
    newest, volume, bars = None, 0, {}
    seen = -1
    for ts, price, v in rows:
        if newest is None or ts >= newest:
            newest, volume = ts, volume + v
        seen = max(seen, ts)
        bars.setdefault(seen // 60, []).append((price, v))
    assert latest.snapshot(latest.mark_stale(trades(spark, *rows), chunk)).first().total_volume == volume
    got = candles.candles(trades(spark, *rows), chunk=chunk).orderBy("start_time").collect()
    want = [(b[0][0], max(p for p, _ in b), min(p for p, _ in b), b[-1][0], sum(v for _, v in b)) for _, b in sorted(bars.items())]
    assert [(c.open, c.high, c.low, c.close, c.volume) for c in got] == want


def test_recursive_indicators():
    r = np.random.default_rng(5)
    close = 100 + r.normal(0, 1, 60).cumsum()
    got = indicators.recursive_frame(pd.DataFrame({"symbol": "A", "start_time": range(60), "close": close, "high": close + 1, "low": close - 1}))
    ema = close[0]
    for x in close[1:]:
        ema = ema + (x - ema) * 2 / 13
    gains = [max(b - a, 0) for a, b in zip(close, close[1:])]
    losses = [max(a - b, 0) for a, b in zip(close, close[1:])]
    up, down = sum(gains[:14]) / 14, sum(losses[:14]) / 14
    for g, x in zip(gains[14:], losses[14:]):
        up, down = (up * 13 + g) / 14, (down * 13 + x) / 14
    assert got["ema_12"].iloc[-1] == pytest.approx(ema) and got["rsi_14"].iloc[-1] == pytest.approx(100 - 100 / (1 + up / down))
    assert got["rsi_14"].isna().sum() == 14 and got["atr_14"].isna().sum() == 13


def test_signal_life():
    bar = lambda t, low, high, score=0.9, valid=True, passes=True: dict(symbol="A", start_time=t, low=low, high=high, is_valid=valid, passes=passes, score=score, take_profit=110.0, stop_loss=95.0)
    rows = [bar(0, 99, 101, 0.5), bar(1, 99, 101), bar(2, 99, 105), bar(3, 94, 111), bar(4, 99, 101), bar(5, 99, 101), bar(6, 99, 101), bar(7, 99, 101), bar(8, 99, 112), bar(9, 1, 1)]
    got = signals.life_frame(pd.DataFrame(rows), cooldown=2)
    assert list(got["event"]) == [None, "ENTRY", None, "STOP_LOSS", None, None, "ENTRY", None, "TAKE_PROFIT", None]


def test_debounce(spark):
    rows = [("A", 60 * m, e) for m, e in ((0, "ENTRY"), (30, "ENTRY"), (59, "ENTRY"), (60, "ENTRY"), (100, "ENTRY"), (30, "STOP_LOSS"))]
    df = spark.createDataFrame(rows, "symbol string, s long, event string").select("symbol", F.timestamp_seconds("s").alias("start_time"), "event")
    got = signals.debounce(df).orderBy("event", "start_time").collect()
    assert [(r.sent, r.priority) for r in got] == [(True, "HIGH"), (False, "HIGH"), (False, "HIGH"), (True, "HIGH"), (False, "HIGH"), (True, "CRITICAL")]
