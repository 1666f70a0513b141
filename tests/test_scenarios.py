"""Small cases with expected results written out."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars, symbols, validate
from tapeloom.operators import candles as cd
from tapeloom.operators import dedup, latest, liveness, mapping, sequence
from tapeloom.sources import frames as fr

BASE = 1_725_300_000  # a multiple of 900 and 3600


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("raw", "kind", "reason"),
    [
        ('{"type":"trade","symbol":"VN30F2409","price":1250.5,"volume":15.0,"timestamp":1724900000}', "event", None),
        ('{"type":"quote","symbol":"TCB","bid_price":24.5,"bid_vol":1000.0,"ask_price":24.6,"ask_vol":500.0,"timestamp":1724900010}', "event", None),
        ('{"type":"heartbeat","timestamp":1724900020}', "control", None),
        ('{"type":"error","code":"E1","message":"no"}', "ParseError", "no"),
        ('{"type":"exchange_error","code":"E1","message":"no"}', "ParseError", "no"),
        ('{"type":"error","code":401,"message":"no"}', "ParseError", "malformed message"),
        ('{"type":"trade","symbol":"HPG","price":1,"timestamp":1724900000}', "ParseError", "missing or malformed field"),
        ('{"type":"trade","symbol":"HPG","price":"1","volume":2,"timestamp":1724900000}', "ParseError", "missing or malformed field"),
        ('{"type":"trade","symbol":"HPG","price":1,"volume":2,"timestamp":1724900000.5}', "ParseError", "missing or malformed field"),
        ('{"type":"news_alert"}', "ParseError", "unknown message type"),
        ("{broken", "ParseError", "malformed message"),
        ('{"type":"heartbeat","timestamp":1724900020} tail', "ParseError", "malformed message"),
        ("{'type':'heartbeat','timestamp':1724900020}", "ParseError", "malformed message"),
        (None, "ParseError", "malformed message"),
        ('{"type":"trade","symbol":"HPG","price":-100,"volume":2,"timestamp":1724900000}', "InvalidPrice", "InvalidPrice"),
        ('{"type":"trade","symbol":"HPG","price":1,"volume":2,"timestamp":0}', "InvalidTimestamp", "InvalidTimestamp"),
    ],
)
def test_frames(spark, raw, kind, reason):
    df = spark.createDataFrame([("F", 1, None, "text", raw)], fr.FRAME_SCHEMA)
    got = fr.convert(fr.parse(df)).first()
    assert (got.error_kind or got.status, got.error_reason) == (kind, reason)


def test_frame_kinds_and_symbol(spark):
    rows = [("F", 1, None, "binary", None), ("F", 2, None, "ping", None), ("F", 3, None, "pong", None), ("F", 4, None, "text", '{"type":"trade","symbol":"  hpg  ","price":28500,"volume":1,"timestamp":1724900000}')]
    got = fr.convert(fr.parse(spark.createDataFrame(rows, fr.FRAME_SCHEMA))).orderBy("seq").collect()
    assert [(r.status, r.msg_type, r.symbol) for r in got] == [("rejected", None, None), ("control", "pong", None), ("control", "pong", None), ("event", "trade", "HPG")]


@pytest.mark.parametrize(
    ("raw", "ms"), [(1725530400000, 1725530400000), (1725530400, 1725530400000), (-1, None), (0, None), (946684799, None), (1000, None), (946684799000, None), (4133980800000, None), (9223372036854775807, None)]
)
def test_epochs(spark, raw, ms):
    assert one(spark, t=F.unix_millis(scalars.from_raw_epoch(F.lit(raw).cast("long")))).t == ms


def test_times(spark):
    t = scalars.from_raw_epoch(F.lit(1725530400000))
    got = one(spark, a=F.unix_millis(scalars.minus(t, 2.5)), b=scalars.minus(t, 30 * 365.25 * 86400), h=F.hour(scalars.to_vietnam_time(t)))
    assert (got.a, got.b, got.h) == (1725530397500, None, 17)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HPG", "HPG"), ("  vnm  ", "VNM"), ("fpt", "FPT"), ("HOSE:HPG", "HPG"), ("HPG.HOSE", "HPG"), ("UPCOM:BSR", "BSR"), ("HNX/SHB", "SHB"), ("  vnm.hose  ", "VNM"),
        ("", None), ("   ", None), ("HP", None), ("HPGG", None), ("123", None), ("HP@", None), ("HOSE", None), ("12345", None),
        ("VN30F2409", "VN30F2409"), ("vn30f2512", "VN30F2512"), ("VN30F", None), ("VN30F2", None), ("VN30F240", None), ("VN30F2413", None), ("VN30F2400", None), ("VN100F2409", None),
        ("VN30", "VN30"), ("  vnindex  ", "VNINDEX"), ("VN50", None), ("HPG:GARBAGE", "HPG"), ("GARBAGE:HPG", None), ("HOSE:VN30", None), ("HNX:VN30F2409", None), (None, None),
    ],
)
def test_symbols(spark, raw, want):
    assert one(spark, i=symbols.canonical(F.lit(raw).cast("string")).canonical).i == want


def test_symbol_options(spark):
    strict = lambda s: symbols.canonical(F.lit(s), strict=True, strip_exchange=True)
    got = one(spark, a=strict("HPG:GARBAGE").canonical, b=strict("HOSE:VN30").canonical, c=strict("HNX:VN30F2409"), d=symbols.canonical(F.lit("vn30f2512")))
    assert (got.a, got.b, got.c.canonical, got.c.year, got.d.month) == (None, "VN30", "VN30F2409", 24, 12)


def test_checks(spark):
    q = lambda *x, **k: validate.quote_error(F.lit("HPG"), *map(F.lit, map(float, x)), **k)
    t = lambda s, p, v: validate.trade_error(F.lit(s), F.lit(p).cast("double"), F.lit(v).cast("double"))
    got = one(
        spark, a=t("HPG", 0.0, 1.0), b=t("HPG", float("nan"), 1.0), c=t("HPG", 1.0, float("inf")), d=t(" \t", 1.0, 1.0), e=t("HPG", 1.0, 1.0), n=t("HPG", None, 1.0),
        f=q(29000, 1, 28500, 1), g=q(28500, 1, 28500, 1), h=q(0, 0, 0, 0), i=q(30000, 500, 0, 0), j=q(0, 0, 26000, 500), k=q(0, 10000, 5, 1), l=q(0, 10000, 5, 1, strict_sides=True), m=q(5, 1, -0.0, 0),
    )
    assert list(got) == ["InvalidPrice", "InvalidPrice", "InvalidVolume", "InvalidSymbol", None, "InvalidPrice", "CrossedMarket", "CrossedMarket", "InvalidPrice", None, None, None, "InvalidVolume", None]


def tape(spark, rows):
    """rows: (kind, symbol, offset, a, b); a, b are price and volume, or bid and ask."""
    made = []
    for n, (kind, symbol, at, a, b) in enumerate(rows):
        trade = kind == "trade"
        made.append(("F", n, kind, symbol, float(at), a if trade else None, b if trade else None, *((None,) * 4 if trade else (a, 100.0, b, 200.0))))
    df = spark.createDataFrame(made, "feed string, seq long, kind string, symbol string, at double, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double")
    t = F.timestamp_micros(((F.col("at") + BASE) * 1_000_000).cast("long"))
    return df.withColumn("ts", t).withColumn("recv_ts", t).drop("at")


def trades(spark, *rows, symbol="HPG"):
    return tape(spark, [("trade", symbol, at, float(p), float(v)) for at, p, v in rows])


def test_dedup(spark):
    q = lambda b, a, t=0: ("quote", "HPG", t, b, a)
    kept = lambda rows, **k: [r.seq for r in dedup.dedup_quotes(tape(spark, rows), **k).orderBy("seq").collect()]
    assert kept([q(1.0, 2.0), q(1.0, 2.0), q(1.5, 2.0), q(1.0, 2.0, 1)]) == [0, 2, 3]
    assert kept([("trade", "HPG", 0, 1.0, 1.0)] * 2) == [0, 1]
    zeros = [q(1.0, 0.0), q(1.0, -0.0)]
    assert kept(zeros) == [0, 1] and kept(zeros, signed_zero="equal") == [0]
    rows = [q(1.0, 2.0), q(2.0, 3.0), q(3.0, 4.0), q(3.0, 4.0), q(1.0, 2.0)]
    assert [r.is_duplicate for r in dedup.mark_duplicates_bounded(tape(spark, rows), 2).orderBy("seq").collect()] == [False, False, False, True, False]


def test_sequencer(spark):
    rows = trades(spark, *((t, 1, 1) for t in (1, 3, 2, 5, 10)))
    got = {r.seq: r.release_seq for r in sequence.release(rows, 2).collect()}
    assert got == {0: 1, 1: 3, 2: 3, 3: 4, 4: None}
    late = sequence.sequence(trades(spark, (10, 1, 1), (7, 1, 1), (8, 1, 1)), 2).orderBy("seq").collect()
    assert [r.is_late for r in late] == [False, True, False]
    bounded = {r.seq: (r.outcome, r.release_seq) for r in sequence.sequence_bounded(trades(spark, (10, 1, 1), (12, 1, 1), (14, 1, 1)), 10, 2).collect()}
    assert bounded == {0: ("evicted", 2), 1: ("flush", None), 2: ("flush", None)}


def test_latest(spark):
    rows = [("trade", "HPG", 1, 28000.0, 5000.0), ("trade", "HPG", 2, 28100.0, 15000.0), ("quote", "HPG", 3, 1.0, 2.0), ("trade", "HPG", 20, 5.0, 1.0), ("trade", "HPG", 15, 6.0, 100.0), ("quote", "HPG", 25, 3.0, 4.0), ("quote", "HPG", 22, 5.0, 6.0)]
    marked = latest.mark_stale(tape(spark, rows))
    got = latest.snapshot(marked).first()
    assert (got.total_volume, got.last_trade.price, got.last_quote.ask_price) == (20001.0, 5.0, 4.0)
    assert sorted(r.seq for r in latest.stale_report(marked).collect()) == [4, 6]
    assert latest.last_price(latest.snapshot(marked), " hpg ").first().price == 5.0 and latest.last_price(latest.snapshot(marked), "VIC").count() == 0


def test_candles(spark):
    got = cd.candles(trades(spark, (5, 28000, 1000), (20, 28500, 2000), (45, 27500, 500), (59, 28200, 1500))).first()
    assert (got.open, got.high, got.low, got.close, got.volume) == (28000, 28500, 27500, 28200, 5000)
    late = trades(spark, (70, 100, 1), (30, 90, 1))
    a = cd.candles(late).collect()
    assert len(a) == 1 and (a[0].open, a[0].low, a[0].close) == (100, 90, 90)
    assert cd.candles(late, mode="event").count() == 2
    marked = cd.mark_closed(cd.all_timeframes(trades(spark, (30, 1, 1000), (65, 2, 1500), (905, 3, 1)), ("M1", "M15")))
    assert [(r.closed_by_seq, r.timeframe, r.volume) for r in cd.close_events(marked).collect()] == [(1, "M1", 1000), (2, "M1", 1500), (2, "M15", 2500)]
    marked = cd.mark_closed(cd.candles(trades(spark, *((60 * k, k + 1, 1) for k in range(5)))))
    assert [r.open for r in cd.history(marked, 3).orderBy("start_time").collect()] == [2, 3, 4]
    assert cd.latest_closed(marked).first().open == 4 and cd.current(marked).first().open == 5


def test_liveness(spark):
    watch = spark.createDataFrame([("  hpg ",), ("VIC",), ("   ",), ("",)], "symbol string")
    seen = tape(spark, [("trade", "HPG", 0, 1.0, 1.0), ("trade", "VNM", 0, 1.0, 1.0)])
    at = lambda s: {r.symbol: r.status for r in liveness.symbol_status(seen, watch, F.timestamp_seconds(F.lit(BASE + s)), 10.0).collect()}
    assert at(5) == {"HPG": "Active", "VIC": "NeverSeen", "VNM": "Untracked"} and at(10)["HPG"] == "Stale"
    beat = tape(spark, [("trade", "HPG", 10, 1.0, 1.0)])
    health = lambda s, hb=5.0, st=30.0: liveness.feed_health(beat, F.timestamp_seconds(F.lit(BASE + s)), hb, st).first().health
    assert [health(s) for s in (12, 16, 45, 3)] == ["Healthy", "HeartbeatMissed", "Stale", "Healthy"] and health(25, 30.0, 10.0) == "Stale"


def test_watch_list(spark):
    df = lambda *x: spark.createDataFrame([(s,) for s in x], "symbol string")
    active = df("HPG", "VNM")
    names = lambda d: [r.symbol for r in d.collect()]
    assert names(mapping.subscribe(active, df("hpg"))) == [] and names(mapping.subscribe(active, df("vic", " fpt "))) == ["FPT", "VIC"]
    assert names(mapping.unsubscribe(active, df("HPG"))) == ["HPG"] and names(mapping.unsubscribe(active, df("VIC"))) == []
    assert mapping.payload("subscribe", active).first().message == '{"type":"subscribe","symbols":["HPG","VNM"]}'
    with pytest.raises(Exception, match="blank symbol"):
        mapping.subscribe(active, df("VIC", "  ")).collect()


def test_aliases(spark):
    aliases = spark.createDataFrame([(1, "VN30F1M", "VN30F2408"), (2, "vn30f1m", "VN30F2409"), (3, "A", "B"), (4, "B", "HPG"), (5, "X", "NOT_A_VALID_TICKER_123")], "reg_no long, alias string, canonical string")
    got = mapping.map_symbols(spark.createDataFrame([("  vn30f1m  ",), ("A",), ("X",), ("HPG",)], "symbol string"), aliases).collect()
    assert [r.symbol for r in got] == ["VN30F2409", None, None, "HPG"]
    assert sorted(r.key for r in mapping.alias_audit(aliases).collect()) == ["A", "X"]
